import corpus_pipeline
from lienwise.llm import queries

from .conftest import prose
from .test_quality import rated


def test_stages(spark, tmp_path):
    docs, marks = rated(spark, 120)
    more = [(1000 + i, prose(2000 + i, 200)) for i in range(6)]
    more += [(1010, more[0][1]), (1011, more[1][1].replace("stone", "rock", 1))]
    passage = " ".join(more[2][1].split()[:80])
    more += [(1020, prose(3000, 60) + " " + passage + " " + prose(3001, 60))]
    item = " ".join(more[3][1].split()[20:60])
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    d.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(char_length(text) as bigint) n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, columns, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{n}"))
        if n < 4:
            assert out.columns == rows.columns
        rows = spark.read.parquet(str(tmp_path / f"s{n}"))
        kept.append({r["doc_id"] for r in rows.select("doc_id").collect()})
    assert {1000, 1001, 1002, 1003, 1004, 1005, 1020} <= kept[0] and sum(i % 3 != 2 for i in kept[0] if i < 120) <= 4
    assert kept[1] >= {1000, 1001, 1002, 1020} and not kept[1] & {1010, 1011}
    text = spark.read.parquet(str(tmp_path / "s2")).where("doc_id = 1020").first()
    assert passage not in text["text"] and text["n_chars"] == len(text["text"])
    assert kept[2] == kept[1] and kept[3] == kept[2] - {1003} and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
