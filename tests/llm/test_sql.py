"""Operators that SQL can express, against DuckDB."""

import pytest
from compare import duck, rows_of
from test_pairs_and_counts import AWKWARD, SCHEMA

from quillstack.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))  # awkward conversations: test_joins_and_tries.py
@pytest.mark.parametrize("which", ["sf0.001", "sf0.01", "awkward"])
def test_operator_equals_sql(spark, tmp_path, name, which):
    if which == "awkward":
        sf = str(tmp_path)
        rows = spark.createDataFrame(AWKWARD, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
        rows.coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").write.parquet(f"{sf}/conversations.parquet")
    else:
        sf = f"/root/testdata/{which}"
    df = queries.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    con = duck("/root/testdata/sf0.001" if which == "awkward" else sf)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet{'/*.parquet' if which == 'awkward' else ''}')")
    found = con.execute(queries.ORACLE_SQL[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


#: The parts of op6 and op7 that SQL can say.
EDITED = """
SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(left(coalesce(text, ''), length(coalesce(text, '')) - h) || left(following, h)) AS edited_sha256 FROM (
  SELECT doc_id, text, length(coalesce(text, '')) // 2 AS h, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following FROM documents)
"""
BASE = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
runs AS (SELECT doc_id, i, list_slice(l, i, i + 7) AS run FROM (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM w WHERE len(l) >= 8)),
again AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM again GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, (len(l) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(l)) AS base_failed
FROM w LEFT JOIN repeated r USING (doc_id) LEFT JOIN dup USING (doc_id)
"""


@pytest.mark.parametrize("name,body", [("op6_lz_fingerprints", EDITED), ("op7_quality_rules", BASE)])
def test_what_sql_can_say_of_an_operator(spark, sf, name, body):
    found = duck(sf).execute(body)
    columns = [d[0] for d in found.description]
    assert rows_of(columns, queries.QUERIES[name](spark, sf).select(*columns).collect()) == rows_of(columns, found.fetchall())
