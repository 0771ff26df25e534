import random
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import edits, text
from quire.operators import metrics

#: fixed sample: reference, prediction and corrected lines of one page
GOLDEN = [
    ("yor parte.", "yor parte, a.", "yor parte, a."),
    ("Pero este discurso repugna a la jurisprudencia, y a la", "ero este discurso epugna a la jurisprudencia, y a la", "Pero este discurso repugna a la jurisprudencia, y a la"),
    ("resolucion mas assentada que ay en este Reyno.", "resolucion mas assentada que ay en este Rteyno, -", "resolucion mas assentada que hay en este Reyno, -"),
    ("Lo primero, que la viuda tiene el primer lugar en la", "Lo primero, que la viuda tiene el primer lugar en la", "Lo primero, que la viuda tiene el primer lugar en la"),
    ("acusacion de la muerte del marido, y demas agravios", "acusacion de la muerte del marido, y demas agravios", "acusacion de la muerte del marido, y demas agravios"),
    ("hechos a su casa, sin que los hijos (quando huvieran acu-", "hechos a sur casa, sin que los hijos squado huvieran acu-", "hechos a su casa, sin que los hijos squado hubieran acu-"),
    ("sado) puedan concurrir con ella, ni ser parte para remi-", "sado puedan concurtir con ella, niser parte para temi-", "sado puedan concurrir con ella, ni ser parte para temi-"),
    ("tir la muerte, como lo assientan los Autores q adelante", "tir la muerre, como lo assientan los Autores qadelante", "tir la muerte, como lo assientan los Autores que adelante"),
    ("se citaran, fundadas en la razon de que el derecho de", "se citaran, sundados en la razon de que el derecho de", "se citaran, fundados en la razon de que el derecho de"),
    ("acusar la muerte, non est quid haereditarium, I. pro haere", "acusan la muerte, non est quid hareditarium. Lpro here", "acusar la muerte, non est quid hereditarium. L. pro here"),
    ("de, §, sin, ff, de acquiren. haered. & sic, la muger aunque", "deS. sin si. de aequitena hared. e sie, la muger aunque", "de §. sin si. de aequitate hered. et sic, la mujer aunque"),
    ("no sea heredera de su marido, se prefiere en la acusacion", "no sea heredeta de su marido, se prefiere en la acusacio", "no sea heredera de su marido, se prefiere en la acusacion"),
    ("de su muerte a los hijos, y a todos los demas consangui-", "de sus muerte a los hijos, y a todos los demas cosangui-", "de su muerte a los hijos, y a todos los demas cosangui-"),
    ("neos porque como por el matrimonio se hizieron am-", "neos: porque como por el matrimonio se hizieron an-", "neos: porque como por el matrimonio se hicieron an-"),
    ("bos una misma carne y sangre, no ay persona mas con-", "bos vnamisma carne y sangte, no ay persona mas con-", "bos una misma carne y sangre, no hay persona mas con-"),
    ("junta que ella, & sunevnares, & vnum fuppofitum, c.", "junta que ella, de funt una rea, es unun suppositum, e", "junta que ella, de fuit una res, es unum suppositum, et"),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def chrf(pairs, beta=2.0):
    scores = []
    for n in range(1, 7):
        grams = lambda s: Counter(s[i : i + n] for i in range(len(s) - n + 1))  # noqa: B023, E731
        both = [(grams(r), grams(h)) for r, h in pairs]
        m, r, h = sum(sum((a & b).values()) for a, b in both), sum(sum(a.values()) for a, _ in both), sum(sum(b.values()) for _, b in both)
        p, q = m / h if h else 0, m / r if r else 0
        scores.append(0 if not m else (1 + beta**2) * p * q / (beta**2 * p + q))
    return sum(scores) / 6


@pytest.mark.parametrize(("column", "char", "word", "score"), [(1, 66, 47, 0.8163006128), (2, 54, 35, 0.8600683250)])
def test_golden_page(spark, column, char, word, score):
    df = spark.createDataFrame([(g[0], g[column]) for g in GOLDEN], "ref string, hyp string")
    row = metrics.rates(metrics.with_edits(df), []).first()
    assert (row.cer_edits, row.cer_chars, row.wer_edits, row.wer_words) == (char, 817, word, 156)
    assert metrics.corpus_chrf(df, []).first().chrf == pytest.approx(score, abs=1e-9)


EDGES = [("", ""), ("", "abc"), ("abc", ""), ("a", "b"), ("niño", "nino"), ("😀 x", "x 😀"), ("éa", "éa"), ("a  b\tc", "a b c"), ("abcde", "abcdef"), ("x" * 50, "y" * 50)]


def test_edits_and_grams_of_edge_cases_and_random_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abñé ") for _ in range(rng.randint(0, 30)))
    pairs = EDGES + [(word(), word()) for _ in range(150)]
    df = spark.createDataFrame(pairs, "ref string, hyp string")
    rows = metrics.with_edits(df).withColumn("g", edits.gram_counts(F.col("ref"), F.col("hyp"))).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.c_edits == distance(r.ref, r.hyp) and r.c_len == max(1, len(r.ref))
        assert r.w_edits == distance(r.ref.split(), r.hyp.split()) and r.w_len == max(1, len(r.ref.split()))
        for n in range(1, 7):
            a, b = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (r.ref, r.hyp))
            assert list(r.g[3 * n - 3 : 3 * n]) == [sum((a & b).values()), sum(a.values()), sum(b.values())]
    assert metrics.corpus_chrf(df, []).first().chrf == pytest.approx(chrf(pairs), abs=1e-12)


def test_distances_of_long_texts_and_of_many_different_words(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcñé ") for _ in range(1500))
    pairs = [(long, "".join(rng.choice("abcñé ") if rng.random() < share else c for c in long)) for share in (0.01, 0.1, 0.4, 1)]
    for r in metrics.with_edits(spark.createDataFrame(pairs, "ref string, hyp string")).collect():
        assert r.c_edits == distance(r.ref, r.hyp) and r.w_edits == distance(r.ref.split(), r.hyp.split())
    many = [f"w{i}" for i in range(50000)]
    other = ["new", *many[:40000], *many[40003:]]
    df = spark.createDataFrame([(" ".join(many), " ".join(other))], "ref string, hyp string")
    assert df.select(edits.word_edits(F.col("ref"), F.col("hyp")).alias("e")).first().e == 4


def test_lists_and_joined_lines(spark):
    df = spark.createDataFrame([(1, "abc", "abd"), (2, "", "x"), (3, "q r", "q\nr")], "n long, ref string, hyp string")
    row = metrics.list_rate(df).first()
    assert (row.edits, row.chars) == (3, 6) and row.cer == pytest.approx(0.5)
    pages = metrics.joined(df, [], [F.col("n")], 2).orderBy("page").collect()
    assert [(r.ref, r.hyp) for r in pages] == [("abc\n", "abd\nx"), ("q r", "q\nr")]


def test_null_hypotheses_count_no_grams(spark):
    df = spark.createDataFrame([("ab", None), (None, "ab")], "ref string, hyp string")
    assert metrics.corpus_chrf(df, []).first().chrf == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("\t 10left ", "a/b/3_line_007.1.png", "  A b/Ç! ")], "a string, p string, s string")
    row = df.select(text.strip(F.col("a")).alias("a"), text.base_name(F.col("p")).alias("b"), text.stem(F.col("p")).alias("c"), text.parent(F.col("p")).alias("d"), text.slug(F.col("s")).alias("e"), text.file_safe(F.col("s")).alias("f"), text.slug(F.lit("¿?")).alias("g")).first()
    assert tuple(row) == ("10left", "3_line_007.1.png", "3_line_007.1", "a/b", "a_b", "A_b", "unknown")
    pages = spark.createDataFrame([(x,) for x in ("10", "2right", "2left", "1", "cover", "2")], "p string")
    key = [text.page_number(F.col("p")), text.side_rank(F.col("p"))]
    assert [r.p for r in pages.orderBy(*key).collect()] == ["1", "2", "2left", "2right", "10", "cover"]
    assert [r.p for r in pages.orderBy(text.natural_key(F.col("p"))).collect()] == ["1", "2", "2left", "2right", "10", "cover"]
    digits = ["9" * 22, "1" + "0" * 22, "1" + "0" * 21 + "1", "7", "x010a", "x9a", "x0010b"]
    rows = spark.createDataFrame([(d,) for d in digits], "p string").orderBy(text.natural_key(F.col("p"))).collect()
    assert [r.p for r in rows] == ["7", "9" * 22, "1" + "0" * 22, "1" + "0" * 21 + "1", "x9a", "x010a", "x0010b"]


def test_present_and_wrapped(spark):
    df = spark.createDataFrame([("\t\u00a0 ",), (None,), (" a\u2003",)], "s string")
    assert [r.p for r in df.select(text.present(F.col("s")).alias("p")).collect()] == [False, False, True]
    said = "one two-three " * 9 + "x" * 30
    assert list(spark.range(1).select(text.wrapped(F.lit(said), 20).alias("w")).first().w) == textwrap.wrap(said, 20)


def test_correction_and_evaluation_forms(spark):
    row = spark.range(1).select(text.corrected(F.lit("coraçon q aq q, éq")).alias("a"), text.evaluation_form(F.lit("vna niña fuè as-")).alias("b")).first()
    assert row.a == "corazon que aq que, éq" and row.b == "una niña sue as"
