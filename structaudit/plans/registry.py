"""All registered queries."""

from structaudit.plans import adjudication, decks, evaluation, mining, pages, resolution, service

QUERIES, SQL = {}, {}
for module in (adjudication, evaluation, mining, resolution, service, pages, decks):
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)
