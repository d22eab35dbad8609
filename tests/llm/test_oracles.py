"""The SQL of the operators that have some, against the operators on odd and near-alike texts."""

import duckdb
import pytest

from wattloom.llm import jaccard, licenses, oracles
from wattloom.llm.shingles import SIZE

from .test_operators import ODD, near_texts

LICENSES = ["gnu General PUBLIC license, MIT license mit license", "Licensed under CC BY-NC 4.0.", "under the Apache License, Version 2.0", "released under the MIT License. all rights reserved. some text. All rights reserved", "apache license 2.0 or gnu general public license", "mit license " * 50]


@pytest.mark.parametrize("name", ["licenses", "jaccard"])
def test_sql_gives_the_same_rows(spark, tmp_path, name):
    texts = [*ODD, *LICENSES, *near_texts(6, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    got, sql = (licenses.scan(docs), oracles.license_scan()) if name == "licenses" else (jaccard.near_classes(docs), oracles.ngram_jaccard_join(jaccard.PERCENT, SIZE))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    rel = con.sql(sql)
    want = rel.fetchall()
    assert rel.columns == got.columns
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    if name == "licenses":
        assert sum(r[2] > 0 for r in want) >= 3
    else:
        assert len({r[2] for r in want}) < len(texts) - 20
