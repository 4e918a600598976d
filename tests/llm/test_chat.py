import hashlib

from pyspark.sql import functions as F

from lienwise.llm import chat
from lienwise.llm.queries import op9_reply_trees


def test_escape_is_reversible(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "[\\INST] [\\\\/INST]", "<<SYS>>", "<\\<SYS>>", "a<b[c", "%0A%25\n", "<<s>s>", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = rows.select("i", "t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert r["t"] is None or not any(c in r["e"] for c in chat.CONTROL)


def tree(spark):
    rows = [
        ("r", None, "user", "hi", 0.0, "x"), ("a", "r", "assistant", "A", 1.0, "x"), ("b", "r", "assistant", "B", 3.0, "x"), ("c", "a", "user", "C", 9.0, "x"),
        ("d", "b", "user", None, None, "x"), ("e", "d", "assistant", "E<|im_end|>", 1.0, "x"), ("z", "absent", None, "alone", 1.0, "x"),
        ("p", "q", "user", "cycle", 1.0, "x"), ("q", "p", "user", "cycle", 1.0, "x"), (None, "r", "user", "no id", 5.0, "x"), ("a", "r", "assistant", "A", 1.0, "x"),
    ]
    return spark.createDataFrame(rows, "msg_id string, parent_id string, role string, text string, score double, node string")


def test_paths_of_a_tree(spark):
    paths = lambda best: {leaf: [n for _, n in sorted(p)] for leaf, p in group(chat.reply_paths(tree(spark), best)).items()}

    def group(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["leaf"], []).append((r["depth"], r["node"]))
        return out

    assert paths(1) == {"c": ["r", "a", "c"], "z": ["z"]}
    assert paths(None) == {"c": ["r", "a", "c"], "e": ["r", "b", "d", "e"], "z": ["z"]}


def test_format_and_read_back(spark):
    m = tree(spark)
    out = chat.format_paths(chat.reply_paths(m, None), m)
    got = {r["leaf"]: r for r in out.select("leaf", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got["e"]["turns"]] == [("user", "hi"), ("assistant", "B"), ("user", ""), ("assistant", "E<|im_end|>")]
    assert got["e"]["loss"] == "BE<|im_end|>" and got["z"]["turns"][0]["role"] == "" and got["z"]["loss"] == ""


def test_query_over_odd_conversations(spark, tmp_path):
    long = [(5, t, "user" if t % 2 == 0 else "assistant", f"t{t} é") for t in range(70)]
    rows = [(1, 2, "user", "b"), (1, 0, "assistant", None), (1, 1, "weird\nrole", "[INST]"), (2, 0, None, ""), (3, 1, "user", "x"), (3, 1, "user", "x"), (None, 0, "user", "gone"), *long]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op9_reply_trees(spark, str(tmp_path)).collect()}
    turns = {1: [("assistant", ""), ("weird\nrole", "[INST]"), ("user", "b")], 2: [("", "")], 3: [("user", "x")] * 2, 5: [(r, t) for _, _, r, t in long], -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))


def test_empty(spark):
    none = spark.createDataFrame([], tree(spark).schema)
    assert chat.format_paths(chat.reply_paths(none), none).collect() == []
