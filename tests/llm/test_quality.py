import numpy as np
import pyarrow as pa

from lienwise.llm import quality

from .conftest import prose


def rated(spark, n=240):
    docs, marks = [], []
    for i in range(n):
        text = prose(1000 + i, 60)
        kind = i % 3
        if kind == 0:
            text = text.replace("river", "badword", 3) + " badword scumlike"
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "x"))
        marks.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return spark.createDataFrame(docs, "doc_id long, text string, top_probability string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, marks = rated(spark)
    model = quality.train(docs.where("doc_id < 160"), quality.grades(marks))
    got = quality.score(docs.where("doc_id >= 160"), model).collect()
    right = sum((r["top_probability"] >= 0.5) == (r["doc_id"] % 3 == 2) for r in got)
    assert len(got) == 80 and right >= 76
    assert model.thresholds[0] <= model.thresholds[1]
    kept = quality.select_good(docs, quality.grades(marks))
    assert kept.columns == docs.columns and {r["top_probability"] for r in kept.collect()} == {"x"}


def test_sample_is_bounded_and_nothing_to_learn_keeps_all(spark, odd_docs, no_docs):
    docs, marks = rated(spark)
    assert len(quality.train(docs, quality.grades(marks), sample=30).thresholds) == 2
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.select_good(odd_docs, quality.grades(none)).count() == odd_docs.count()
    assert quality.score(no_docs, quality.train(no_docs, quality.grades(marks))).collect() == []


def test_odd_texts_score(spark, odd_docs):
    docs, marks = rated(spark)
    model = quality.train(docs, quality.grades(marks))
    got = quality.score(odd_docs, model).collect()
    assert len(got) == 13 and all(0 <= r["expected_grade"] <= 2 for r in got)
    assert len({r["top_probability"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1


def test_gradient():
    texts = pa.array([prose(i, 20) for i in range(30)])
    ptr, dim, value = quality.features(texts)
    assert np.allclose([np.sum(value[a:b] ** 2) for a, b in zip(ptr, ptr[1:])], 3, atol=0.3)
    assert np.all(np.diff(ptr) > 0)


def test_shapes_and_repeats():
    ptr, dim, _ = quality.features(pa.array(["AAA!! bb1", "C!! ddd22", "x x x", None]))
    shape = lambda i: {d for d in dim[ptr[i] : ptr[i + 1]] if d >= (1 << 18)}
    assert shape(0) == shape(1) and quality.DIMENSIONS - 1 in dim[ptr[2] : ptr[3]] and ptr[3] == ptr[4]
