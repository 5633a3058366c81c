"""SQL twins of shards and personal data on hand-made rows: odd texts, repeated rows, null ids, planted accounts."""

import random

import duckdb
import pytest

from structaudit.llm import queries

BITS = [
    "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "1.2.3.4.5.6", "300.1.1.1", "a.b@c.d", "b_@x@y.z", "+1 (743) 555-3824", " ", "-", "é😀", "9", "card",
    "iban DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 3", "ssn 123-45-6789", "123-45-6789", "part", "\n", "host ", "Visa: ",
]


@pytest.mark.parametrize("name", ["op4_feistel_shards", "op6_pii"])
@pytest.mark.parametrize("given", ["odd", "mixed", "nothing"])
def test_twin_gives_the_same_rows(spark, tmp_path, request, documents, name, given):
    rng = random.Random(21)
    mixed = [(rng.choice([i, i, None]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for i in range(1_200)]
    docs = documents(mixed + mixed[:50]) if given == "mixed" else request.getfixturevalue(given)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    order = lambda rows: sorted(rows, key=repr)
    twin = base.execute(queries.SQL[name])
    assert [c[0] for c in twin.description] == got.columns
    assert order(tuple(r) for r in got.collect()) == order(twin.fetchall())
