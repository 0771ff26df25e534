import hashlib
import random

from pyspark.sql import functions as F

from quire.llm import chat_format as cf

NASTY = ["", "<|end|>\n", "\\", "\\<|text|>", "<", "|", "<\\|next|>", "a\nb", "\\### Assistant: </turn> ok", "<|<|", "\\\\<|start|>user<|text|>", "😀é"]


def turns():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|x", None]), rng.choice(NASTY + [None])) for c in range(40) for t in range(rng.randint(1, 9))]
    return rows + [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, 0, "assistant", "b"), (None, 1, "user", "x"), (51, None, "user", "first"), (51, 0, "assistant", "then")]


def test_round_trip_and_mask(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "runs": F.lit(2)}).repartition(4)
    out = cf.format_conversations(df).withColumns({"back": cf.read_turns(F.col("formatted")), "loss": cf.masked_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(want)
    for row in out:
        ordered = sorted(want[row.conv_id])
        assert [(t.role, t.text) for t in row.back] == [(r, x) for _, _, r, x in ordered]
        assert row.loss == "".join(x for _, _, r, x in ordered if r == "assistant")
        for s in row.loss_spans:
            assert "<|" not in row.formatted[s.start : s.start + s.length]
        runs = sum(i == 0 or ordered[i][2] != ordered[i - 1][2] for i in range(len(ordered)))
        assert row.formatted.count("<|start|>") == row.formatted.count("<|end|>\n") == runs
    assert cf.format_conversations(df.where("false")).count() == 0


def test_query_has_the_probe(spark, sf_dir):
    from quire.llm import queries

    row = queries.op4_chat_formatting(spark, sf_dir).where("conv_id = -7").first()
    text = queries.PROBE
    assert (row.n_turns, row.loss_chars) == (2, len(text)) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
