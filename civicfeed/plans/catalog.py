"""All queries of the library over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import cases, chats, corpus, feeds, more, pages, records, texts

FLAGSHIP = "c13_city_feed"

QUERIES = cases.QUERIES | chats.QUERIES | corpus.QUERIES | feeds.QUERIES | more.QUERIES | pages.QUERIES | records.QUERIES | texts.QUERIES
ORACLE_SQL = cases.ORACLE_SQL | chats.ORACLE_SQL | corpus.ORACLE_SQL | feeds.ORACLE_SQL | more.ORACLE_SQL | pages.ORACLE_SQL | records.ORACLE_SQL | texts.ORACLE_SQL
