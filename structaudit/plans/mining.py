"""Text to candidate names, over ``documents`` and ``pages``.

The SQL twins work on exploded tokens and rejoin neighbours with ``lead``; the miner works on
arrays inside a line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.operators import mining as mn
from structaudit.operators.ranking import top_k
from structaudit.plans import derived as d
from structaudit.plans.derived import DICT_SQL, with_cte

QUERIES, SQL = {}, {}


def query(name, sql=None, *ctes):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


BREAK_SQL = tx.LINE_BREAK.replace("'", "''")
TOKEN_SQL = tx.TOKEN.replace("'", "''")
TRIM_SQL = tx.TRIMMED.replace("'", "''")

# Chemistry is rare in the given prose: every document gets a line built from its own first words,
# so that locants, prefixes, vitamins, brackets and Greek letters occur in every copy of it.
CHEM = (
    "concat(text, chr(10), '(', substr(lower(source), 1, 3), 'yl)-Amine 2-', coalesce(nullif(regexp_extract(text, '([A-Za-z]{4,})', 1), ''), 'x'), "
    "'ol, vitamin C and Vitamins b', cast(doc_id % 13 as {text}), chr(10), "
    "'(((β-', lower(lang), 'ene)) [', coalesce(nullif(regexp_extract(text, '([a-z]{5,})', 1), ''), 'y'), 'ate], (R)-', source, ' acid. C9H8O4 ACN', cast(doc_id % 7 as {text}), ' DMSO')"
)
DOCS_SQL = f"docs as (select doc_id, {CHEM.replace('{text}', 'varchar')} as text from documents)"


def docs(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.expr(CHEM.replace('{text}', 'string')).alias("text"))


def _peel(expr: str) -> str:
    """SQL for the bracket peeling of one token: three loops, one reduction step per character."""
    trimmed = lambda e: f"trim({e}, '{TRIM_SQL}')"
    count = lambda t, c: f"(length({t}) - length(replace({t}, {c}, '')))"
    partner = lambda c: f"translate({c}, '()[]', ')(][')"

    def loop(inner: str, acc: str, step: str) -> str:
        return f"list_reduce(list_transform(range(0, 40), lambda q{acc}: {inner}), lambda {acc}, z{acc}: {step})"

    a_first, a_last, inner = "left(a, 1)", "right(a, 1)", "substr(a, 2, length(a) - 2)"
    unwrap = (
        f"case when length(a) > 2 and {a_first} in ('(', '[') and {a_last} = {partner(a_first)} "
        f"and {count(inner, a_first)} = {count(inner, a_last)} then {trimmed(inner)} else a end"
    )
    b_last = "right(b, 1)"
    drop_last = (
        f"case when {b_last} in (')', ']') and {count('b', partner(b_last))} < {count('b', b_last)} "
        f"then {trimmed('left(b, length(b) - 1)')} else b end"
    )
    c_first = "left(c, 1)"
    drop_first = (
        f"case when {c_first} in ('(', '[') and {count('c', partner(c_first))} < {count('c', c_first)} "
        f"then {trimmed('substr(c, 2)')} else c end"
    )
    return loop(loop(loop(expr, "a", unwrap), "b", drop_last), "c", drop_first)


def _greek(expr: str) -> str:
    for greek, latin in tx.GREEK.items():
        expr = f"replace({expr}, '{greek}', '{latin}')"
    return expr


def tokens_sql(source: str) -> str:
    """CTEs lines, raw, distinct_tokens, tok(doc_id, line_no, start, w)."""
    return f"""
lines as (select doc_id, generate_subscripts(arr, 1) - 1 as line_no, unnest(arr) as line
          from (select doc_id, regexp_split_to_array(text, '{BREAK_SQL}') as arr from {source})),
raw as (select doc_id, line_no, generate_subscripts(arr, 1) as k, unnest(arr) as token
        from (select doc_id, line_no, regexp_extract_all(line, '{TOKEN_SQL}') as arr from lines)),
plain as (select token, {_greek(f"trim(token, '{TRIM_SQL}')")} as p from (select distinct token from raw)),
peeled as (select token, case when regexp_matches(p, '^[(\\[]|[)\\]]$') then {_peel('p')} else p end as w from plain),
cleaned as (select token, w from peeled where length(w) >= 2 and regexp_matches(w, '[A-Za-zα-ω]')),
tok as (select doc_id, line_no, row_number() over (partition by doc_id, line_no order by k) - 1 as start, w
        from raw join cleaned using (token))
"""


LOW_STEREO = tx.STEREO
#: CTE flagged: what each word of ``tok`` is.
FLAGGED_SQL = f"""
flagged as (
  select w, lower(w) in ({quoted(tx.STOPWORDS + tx.NOISE)}) or regexp_matches(w, '^[.,]*[0-9][.,0-9]*$')
              or (regexp_matches(w, '[0-9]') and regexp_matches(w, '{tx.FORMULA_WORD}')) as bad,
         lower(w) in ({quoted(tx.BARE)}) as bare,
         case when list_has_any([regexp_replace(trim(lower(w), '()[]'), '(?i)^{LOW_STEREO}', '')], ['acid'])
                or regexp_matches(trim(lower(w), '()[]'), '({'|'.join(tx.SUFFIXES)})$') then 3 else 0 end as suffix,
         regexp_matches(w, '(?i)^{LOW_STEREO}') as stereo,
         regexp_matches(lower(w), '{tx.LOCANT}') as locant,
         regexp_matches(lower(w), '{'|'.join(tx.FRAGMENTS)}') as fragment,
         case when length(w) >= 5 and regexp_matches(w, '^[A-Z]') and not contains(w, '-') then 1.0 else 0.0 end
         + case when regexp_matches(w, '^[A-Za-z]{{2,6}}$') and length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2 then 0.5 else 0.0 end as alone
  from (select distinct w from tok))
"""
FLAGS_SQL = FLAGGED_SQL + f""",
seq as (select doc_id, line_no, start, w, n,
               [w, lead(w, 1) over v, lead(w, 2) over v, lead(w, 3) over v] as ws,
               [bad, lead(bad, 1) over v, lead(bad, 2) over v, lead(bad, 3) over v] as bads,
               [locant or fragment, false] as unused, bare, alone, stereo,
               [suffix, lead(suffix, 1) over v, lead(suffix, 2) over v, lead(suffix, 3) over v] as sufs,
               [stereo, lead(stereo, 1) over v, lead(stereo, 2) over v, lead(stereo, 3) over v] as sters,
               [locant, lead(locant, 1) over v, lead(locant, 2) over v, lead(locant, 3) over v] as locs,
               [fragment, lead(fragment, 1) over v, lead(fragment, 2) over v, lead(fragment, 3) over v] as frags
        from (select *, 0 as n from tok join flagged using (w))
        window v as (partition by doc_id, line_no order by start)),
grams as (
  select doc_id, line_no, start, k as n, array_to_string(ws[1:k], ' ') as phrase,
         case when k = 2 and regexp_matches(lower(array_to_string(ws[1:2], ' ')), '^vitamins? [a-k][0-9]{{0,2}}$') then 4.0
         else sufs[k] + case when stereo or sters[k] then 2.0 else 0 end
              + case when list_bool_or(locs[1:k]) then 2.0 else 0 end + case when list_bool_or(frags[1:k]) then 2.0 else 0 end
              + case when k = 1 then alone else 0 end end as value
  from seq, range(1, 5) g(k)
  where ws[k] is not null and not list_bool_or(bads[1:k]) and not (k = 1 and bare)),
scored as (
  select doc_id, line_no, 2 as source, n, start, phrase,
         case when n = 2 and regexp_matches(lower(phrase), '^vitamins? [a-k][0-9]{{0,2}}$') then 4.0::double
              else value::double + n * 0.5::double end as score
  from grams where value > 0 and length(phrase) between 3 and 120
  union all
  select doc_id, line_no, 0, 0, generate_subscripts(hits, 1), 'vitamin ' || upper(unnest(hits)), 4.0::double
  from (select doc_id, line_no, regexp_extract_all(line, '(?:vitamins?|비타민)\\s*([A-Ka-k]\\d{{0,2}})\\b', 1) as hits from lines)),
cands as (select doc_id, arg_max(phrase, row(score, -line_no, -source, -n, -start)) as phrase, max(score) as score,
                 min(row(line_no, source, n, start)) as pos
          from scored group by doc_id, lower(phrase))
""".replace("               [locant or fragment, false] as unused, bare,", "               bare,")


@query(
    "text_lines",
    f"""select doc_id, line_no, md5(line) as digest from (
      select doc_id, generate_subscripts(arr, 1) - 1 as line_no, unnest(arr) as line, len(arr) as n
      from (select doc_id, regexp_split_to_array(text, '{BREAK_SQL}') as arr from documents))
    where line <> '' or line_no < n - 1""",
)
def text_lines(spark, sf):
    found = mn.lines(d.table(spark, sf, "documents"), ["doc_id"], "text")
    return found.select("doc_id", "line_no", F.md5("line").alias("digest"))


@query(
    "clean_tokens", "select doc_id, line_no, start as token_no, w as token from tok", DOCS_SQL, tokens_sql("docs"),
)
def clean_tokens(spark, sf):
    return mn.tokens(docs(spark, sf), ["doc_id"], "text").select("doc_id", "line_no", "token_no", "token")


@query(
    "scored_ngrams", "select doc_id, line_no, start, n, phrase, score from scored where source = 2",
    DOCS_SQL, tokens_sql("docs"), FLAGS_SQL,
)
def scored_ngrams(spark, sf):
    grams = mn.ngrams(docs(spark, sf), ["doc_id"], "text")
    return grams.select("doc_id", "pos.line_no", "pos.start", F.col("pos.words").alias("n"), "phrase", "score")


CLAUSE = r"[.,;\n]| and "


@query(
    "phrase_scores",
    """select phrase, n_words, case when noise then -1.0 when vitamin then 4.0 when value > 0 then value + least(n_words, 4) * 0.5 else -1.0 end::double as score, noise as is_noise
    from (select phrase, n_words, bool_or(bad) or (n_words = 1 and bool_or(bare)) as noise,
                 n_words = 2 and regexp_matches(lower(phrase), '^vitamins? [a-k][0-9]{0,2}$') as vitamin,
                 (max(suffix) filter (k = n_words) + case when bool_or(stereo and k in (1, n_words)) then 2 else 0 end + case when bool_or(locant) then 2 else 0 end
                  + case when bool_or(fragment) then 2 else 0 end + case when n_words = 1 then max(alone) else 0 end)::double as value
          from tok join flagged using (w) group by phrase, n_words)""",
    DOCS_SQL,
    f"""phrases as (select distinct trim(regexp_replace(clause, '\\s+', ' ', 'g')) as phrase from docs, unnest(regexp_split_to_array(text, '{CLAUSE}')) u(clause)),
    tok as (select phrase, len(ws)::int as n_words, generate_subscripts(ws, 1) as k, unnest(ws) as w from (select phrase, string_split(phrase, ' ') as ws from phrases where phrase <> ''))""",
    FLAGGED_SQL,
)
def phrase_scores(spark, sf):
    """Every different clause of the texts, of any number of words, graded as a name; -1 for what is none."""
    clauses = docs(spark, sf).select(F.explode(F.split("text", CLAUSE)).alias("clause"))
    phrases = clauses.select(tx.collapse_blanks(F.col("clause")).alias("phrase")).where("phrase <> ''").distinct()
    return phrases.select(
        "phrase", F.size(F.split("phrase", " ")).alias("n_words"), tx.candidate_score(F.col("phrase")).alias("score"), tx.is_noise(F.col("phrase")).alias("is_noise"),
    )


@query(
    "candidate_names", "select doc_id, phrase, score, pos[1] as line_no from cands", DOCS_SQL, tokens_sql("docs"), FLAGS_SQL,
)
def candidate_names(spark, sf):
    found = mn.candidates(docs(spark, sf), ["doc_id"], "text")
    return found.select("doc_id", "phrase", "score", "pos.line_no")


@query(
    "candidate_budget",
    """select doc_id, row_number() over (partition by doc_id order by score desc, pos) as rank, phrase, score from cands qualify rank <= 25""",
    DOCS_SQL, tokens_sql("docs"), FLAGS_SQL,
)
def candidate_budget(spark, sf):
    found = mn.candidates(docs(spark, sf), ["doc_id"], "text")
    return top_k(found, ["doc_id"], [F.desc("score"), F.asc("pos")], 25).select("doc_id", "rank", "phrase", "score")


@query(
    "page_references",
    """select doc_id, row_number() over (partition by doc_id order by rank) - 1 as ref_no, name, inchikey from (
      select doc_id, inchikey, min(rank) as rank, arg_min(phrase, rank) as name
      from (select doc_id, phrase, row_number() over (partition by doc_id order by score desc, pos) as rank from cands qualify rank <= 25)
      join dict on name_key = lower(phrase) group by 1, 2)
    qualify ref_no < 3""",
    DOCS_SQL, tokens_sql("docs"), FLAGS_SQL, DICT_SQL,
)
def page_references(spark, sf):
    found = mn.candidates(docs(spark, sf), ["doc_id"], "text")
    refs = mn.page_references(found, ["doc_id"], d.dictionary(spark, sf))
    return refs.select("doc_id", "ref_no", "name", "inchikey")


LABEL_SQL = r"""
labels_raw as (select page_id, regexp_replace(unnest(regexp_split_to_array(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\r?\n')), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as line from pages),
label_lines as (select page_id, line, regexp_split_to_array(line, '[\s\p{Z}]+') as ws from labels_raw where length(line) between 3 and 60),
label_cands as (
  select distinct page_id, candidate from (
    select page_id, line as candidate from label_lines
    union all select page_id, regexp_replace(unnest(regexp_split_to_array(line, '[(),;]')), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') from label_lines
    union all select page_id, array_to_string(ws[i:i + n - 1], ' ') from label_lines, range(1, 5) g(n), range(1, 61) h(i) where i + n - 1 <= len(ws))
  where length(candidate) between 3 and 60)
"""


def label_text(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text")
    )


@query(
    "label_text_candidates",
    """select page_id, candidate, regexp_replace(lower(candidate), '[^a-z0-9가-힣]', '', 'g') as norm,
    regexp_matches(candidate, '^[A-Za-z][A-Za-z0-9\\-,''()\\s]*$') and regexp_matches(candidate, '[A-Za-z]{3,}') as latin from label_cands""",
    LABEL_SQL,
)
def label_text_candidates(spark, sf):
    found = mn.label_text_candidates(label_text(spark, sf), ["page_id"], "text")
    return found.select(
        "page_id", "candidate", tx.match_key(F.col("candidate")).alias("norm"),
        tx.looks_like_latin_name(F.col("candidate")).alias("latin"),
    )
