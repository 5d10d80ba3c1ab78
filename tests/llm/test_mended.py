"""Cases that earlier versions got wrong: lost links, thresholds that depend on partitions, one text under two sources, runs of blanks."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from pairmill.llm import mixing, neardup, quality, tokencount


def brute_components(rows, width=4, percent=80):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_buckets_of_two(spark):
    """Triples a, b, c where a and c are the ends of b and both links are exactly at 80 %; stars of unlike leaves."""
    rng = random.Random(11)
    rows = []
    for t in range(600):
        words = [f"t{t}x{k}" for k in range(103)]
        rows += [(" ".join(words[:83])), " ".join(words), " ".join(words[20:])]
    for t in range(200):
        words = [f"s{t}x{k}" for k in range(100)]
        rows.append(" ".join(words))
        for leaf in range(5):  # each leaf changes another place, so no two leaves reach 80 %
            own = list(words)
            for k in range(2):
                own[leaf * 20 + 5 + k * 8] = f"l{t}y{leaf}y{k}"
            rows.append(" ".join(own))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = list(zip(order, rows))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("by", [["lang"], ["all"]])
def test_exact_quantile(spark, by):
    """The same value under every partitioning, and the one that sorting gives."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), round(rng.lognormvariate(2, 0.4), 6), 0) for _ in range(60_000)] + [("c", 5.0, 0)] + [("d", 7.123456, 0)] * 500
    want = {}
    for r in rows:
        want.setdefault(r[0] if by == ["lang"] else 0, []).append(r[1])
    want = {k: sorted(v)[max(1, -(-len(v) * 985 // 1000)) - 1] for k, v in want.items()}
    for n in (1, 7, 24):
        df = spark.createDataFrame(rows, "lang string, p double, all int").repartition(n)
        assert {r[0]: r["at"] for r in quality.exact_quantile(df, by, "p", 0.985).collect()} == want
    assert quality.exact_quantile(df.where("p < 0"), by, "p", 0.985).collect() == []


def test_judgements_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 40))) for _ in range(15_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append(sorted(map(tuple, quality.judged(docs.repartition(n), labels).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]


def test_mixing_stage_keeps_sources_apart(spark):
    rows = [(1, "a b c", "A"), (1, "a b c", "B"), (2, "d e f g", "A"), (3, "h i", "B"), (4, "j k l m n", None), (4, "j k l m n", None)] + [(5, "o p q", "B")] * 7
    docs = spark.createDataFrame([(i, t, s, n % 2) for n, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, more int")
    key = ["doc_id", "source"]
    want = {tuple(r[:2]): r[2] for r in mixing.mix(docs).groupBy(*key).agg(F.sum("copies")).collect() if r[2]}
    out = mixing.mixed(docs)
    assert {tuple(r[:2]): r[2] for r in out.groupBy(*key).count().collect()} == want
    assert out.columns == docs.columns and out.exceptAll(docs).select("doc_id").distinct().count() <= 5
    each = sorted(r["count"] for r in out.where("doc_id = 5").groupBy("more").count().collect())
    assert each[-1] - each[0] <= 3  # copies are shared out among rows that differ elsewhere


def test_runs_of_blanks(spark):
    """Equal to the library's own segmentation of whole texts, uncut."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = tokencount.unigram_vocabulary(path)
    tok = Tokenizer(models.Unigram([*vocabulary, ("<none>", -1e9)], len(vocabulary), False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always", split=False)
    texts = ["x        y", "col1    col2      col3", "def f():\n    return 1", "  lead", " lead", "tail  ", "tail ", "    ", " ", "a▁b ▁ c", "▁▁", "a  b c   d e", "a\tb"]
    rng = random.Random(2)
    texts += ["".join(rng.choice([" ", " ", "a", "the", "ing", "\n", "é", "▁"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = tokencount.counter(path)(texts).tolist()
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert [(t, n) for t, n in zip(texts, got)] == [(t, count(t)) for t in texts]
