"""Near copies against brute force over all pairs, and names of SimHash components on odd ids."""

import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import near_copies, simhash
from vecspark.llm.common import shared_dir

WORD = re.compile("[^\x20\x09-\x0d]+")


def five(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_groups(texts):
    """id -> least id of those that a chain of similarities of 0.8 joins."""
    sets, up = {i: five(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and up[i] != up[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((up[i], up[j]))
                up = {k: low if v == high else v for k, v in up.items()}
    return up


def edited(rng, words, k):
    words = list(words)
    for at in rng.choice(len(words), k, replace=False):
        words[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def planted(rng, pairs):
    """Texts, and pairs of a text and its copy with some words replaced."""
    texts = {}
    for n in range(pairs):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        texts[2 * n] = " ".join(words)
        texts[2 * n + 1] = edited(rng, words, int(rng.integers(0, max(1, len(words) // 35))))
    return texts


@pytest.mark.parametrize(("near", "cell"), [(8, 16_384), (64, 16)])
def test_groups_equal_brute_force(spark, monkeypatch, near, cell):
    """Nothing is joined that isn't similar; nine of ten similar pairs are found, whatever cells they are in."""
    monkeypatch.setattr(near_copies, "NEAR", near)
    monkeypatch.setattr(simhash, "CELL", cell)
    texts = planted(np.random.default_rng(5), 150)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.group for r in near_copies.groups(docs).collect()}
    want = slow_groups(texts)
    sets = {i: five(t) for i, t in texts.items()}
    assert all(got[i] == i or jaccard(sets[i], sets[got[i]]) >= 0.8 for i in texts)
    similar = [i for i in texts if want[i] != i]
    assert len(similar) > 80 and sum(got[i] != i for i in similar) >= 0.9 * len(similar)


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 to 0.82: at least nine of ten are within the radius."""
    rng, near, every = np.random.default_rng(1), 0, 0
    while every < 300:
        words = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(60, 400)))]
        a, b = " ".join(words), edited(rng, words, max(1, len(words) // 46))
        if 0.8 <= jaccard(five(a), five(b)) <= 0.82:
            x, y = (near_copies.fingerprint(near_copies.shingles(t.encode())) for t in (a, b))
            near += sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= near_copies.RADIUS
            every += 1
    assert near >= 0.9 * every


def test_odd_rows(spark):
    """One document of each group stays; null ids stay; negative ids, repeated rows, clashing columns, no words."""
    text = "one two three four five six seven"
    rows = [(5, text), (-3, text.upper()), (None, text), (9, text), (9, text), (1, None), (2, " "), (4, "other words are in this text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _copy", "2 AS f0", "3 AS size")
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("-3", text.upper()), ("None", text), ("1", "None"), ("4", "other words are in this text")])
    assert near_copies.without_near_copies(docs.limit(0)).count() == 0


def test_small_tables_are_few_files(spark):
    """However many partitions a shuffle has, tables of a few rows between the steps are a file each; the groups are the same."""
    docs = spark.createDataFrame(list(planted(np.random.default_rng(3), 60).items()), "doc_id bigint, text string")
    at = f"{shared_dir(spark).removeprefix('file:')}/vecspark"
    want = sorted(map(tuple, near_copies.without_near_copies(docs).collect()))
    before = set(glob.glob(f"{at}/*"))
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, near_copies.without_near_copies(docs).collect())) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    new = {x: len(glob.glob(f"{x}/part-*")) for x in set(glob.glob(f"{at}/*")) - before}
    small = {x: n for x, n in new.items() if re.search("/(classes|found|nodes|links|copies)-", x)}
    assert len(small) > 5 and set(small.values()) == {1}


def test_components_have_names_whatever_the_ids(spark):
    """Negative ids name their groups also where another group has null ids only."""
    docs = spark.createDataFrame([(-5, "a b c d"), (7, "a b c d"), (None, "quite another text here"), (-9, "x"), (None, "x")], "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit(2))
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.simhash(docs).collect()), key=str)
    assert rows == sorted([(-5, -5), (7, -5), (None, None), (-9, -9), (None, -9)], key=str)
