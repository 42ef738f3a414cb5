"""Operators that SQL can't express against brute force, exact round trips and planted cases."""

import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import components, decontaminate, fm_index, html_extract, license_scan, sentencepiece_codec, simhash, substring, token_output, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n", "a", "a b", "É é A\x0bb\x85c", "x " * 400, "<|endoftext|> a  b\n\n c\t", "日本語 😀 \u2581 y", "w" * 3000]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# Token output.


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, ODD, 100_000)).union(spark.createDataFrame([(None, "null id"), (7, "again"), (7, None)], "doc_id bigint, text string"))
    path = token_output.new_path(spark, "tokens")
    token_output.write_tokens(docs, path)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = sorted(map(tuple, docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, token_output.digests(spark, path).collect()), key=key) == want
    assert {r.doc_id for r in token_output.find(spark, path, [5, 7]).collect()} == {5, 7}


def test_files_have_indexes_and_filters(spark, tmp_path):
    import glob

    from pyarrow import orc

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_output.write_tokens(docs, f"{tmp_path}/t")
    files = [orc.ORCFile(f) for f in glob.glob(f"{tmp_path}/t/*.orc")]
    assert sum(f.nrows for f in files) == 200
    assert all(f.row_index_stride == 1000 and f.stripe_statistics_length > 0 for f in files if f.nrows)
    ids = [x for f in files for x in [f.read(columns=["doc_id"]).column(0).to_pylist()] if x]
    assert all(x == sorted(x) for x in ids)
    plan = token_output.find(spark, f"{tmp_path}/t", [5, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [5,7])]" in plan
    plain = dict(token_output.ORC)
    plain.pop("orc.bloom.filter.columns")
    token_output.read_tokens(spark, f"{tmp_path}/t").coalesce(1).write.options(**token_output.ORC).orc(f"{tmp_path}/with")
    token_output.read_tokens(spark, f"{tmp_path}/t").coalesce(1).write.options(**plain).orc(f"{tmp_path}/without")
    size = lambda name: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{name}/*.orc"))
    assert size("with") > size("without")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab thE ,.'s re\n\t\xa0é日1 23-#$\x1c\r!?"), max_size=40))
def test_words_equal_the_library_on_any_text(text):
    words = token_output.opened(token_output.TOKENIZER)
    assert np.frombuffer(words.text(text), "<i4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_the_library_s_ids(name):
    words = token_output.opened(name)
    for text in ["the cat sat.", "Two  words\nand a line\t", "It's 12:30, d'accord? \u00e9", ""]:
        assert np.frombuffer(words.text(text), "<i4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_equal_ids_are_parted_by_their_texts(spark, monkeypatch):
    """Rows of one id, or of none, go to several parts, in the order of their texts."""
    monkeypatch.setattr(token_output, "parts_for", lambda docs: 8)
    docs = spark.createDataFrame([(None if i % 2 else 5, f"{i * 7919 % 1000:04d} text") for i in range(1000)], "doc_id bigint, text string").withColumn("part", F.lit("clash"))
    path = token_output.new_path(spark, "equal")
    token_output.write_tokens(docs, path)
    rows = token_output.read_tokens(spark, path)
    assert rows.select("part").distinct().count() >= 6
    got = sorted(token_output.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 500 + [5] * 500 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    words = token_output.opened(token_output.TOKENIZER)
    texts = sorted(f"{i * 7919 % 1000:04d} text" for i in range(1000) if i % 2) + sorted(f"{i * 7919 % 1000:04d} text" for i in range(1000) if not i % 2)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(words.text(t) + (2).to_bytes(4, "little")) for t in texts]


# SentencePiece.


@pytest.fixture(scope="session")
def codec():
    with open(sentencepiece_codec.model_path(), "rb") as f:
        return sentencepiece_codec.Codec(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abtheing  .,\n1é0-=_日\u2581"), max_size=60))
def test_pieces_equal_the_library(codec, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    ids = np.frombuffer(codec.encode(text, sentencepiece_codec.Words(codec)), "<i4").tolist()
    assert ids == sp.encode(text)
    assert codec.decode(ids) == text.replace("\u2581", " ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abthein日"), min_size=1, max_size=10))
def test_viterbi_finds_the_best_of_all_segmentations(codec, text):
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max((best[a] + (codec.score_of.get(text[a:end], codec.unknown if end - a == 1 else float("-inf")))) for a in range(end)))
    ids, score, at = codec.by_score(text), 0.0, 0
    while at < len(ids):
        piece = codec.pieces[ids[at]]
        if piece.startswith("<0x"):
            score, at = score + codec.unknown, at + 3
        else:
            score, at = score + codec.scores[ids[at]], at + 1
    assert score == best[-1]


def test_round_trip_of_rows(spark):
    coded = sentencepiece_codec.encode(frame(spark, ODD))
    texts = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded).collect()}
    assert texts == {i: (t or "").replace("\u2581", " ") for i, t in enumerate(ODD)}
    assert all(r.round_trip == ("\u2581" not in (ODD[r.doc_id] or "")) for r in coded.collect())


# SimHash.


def slow_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Of rows (id, fingerprint): the least id that each reaches."""
    names = sorted({f: min((i for i, g in fps if g == f and i is not None), default=None) for _, f in fps}.items())
    group = {f: {f} for f, _ in names}
    for i, (a, _) in enumerate(names):
        for b, _ in names[:i]:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    ids = dict(names)
    return {f: min((ids[g] for g in group[f] if ids[g] is not None), default=None) for f, _ in names}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, ODD, 1000)).union(spark.createDataFrame([(None, "only null"), (5, "a b")], "doc_id bigint, text string"))
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    roots = slow_components(rows)
    want = sorted((str(i), format(f, "016x"), str(roots[f])) for i, f in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash(docs).collect()) == want


@pytest.mark.parametrize(("cell", "blocks"), [(16_384, 4), (16_384, 5), (8, 4), (2, 4)])
def test_links_of_near_fingerprints(spark, monkeypatch, cell, blocks):
    """Chains of near fingerprints, also when cells are dealt by bands."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for _ in range(180):
        f = fps[int(rng.integers(0, len(fps)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            f ^= 1 << int(b)
        fps.append(f)
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "CELL", cell)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, id bigint")
    roots = {r.node: r.root for r in components.components(simhash.fingerprint_links(nodes, 3, blocks)).collect()}
    want = slow_components(list(enumerate(fps)))
    assert [roots.get(i, i) for i in range(len(fps))] == [want[f] for f in fps]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_of_any_links(spark, links):
    up = list(range(31))
    for _ in range(31):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.node: r.root for r in found.collect()} == {i: u for i, u in enumerate(up) if u != i}


# URL filter.


def test_probe_survives_collisions():
    table = url_filter.sorted_table(["a", "b", "c"])
    table["digests"] = np.full(3, url_filter.sorted_table(["b"])["digests"][0])
    assert url_filter.probe(table, ["b", "zz"])[1] == -1 and url_filter.probe(table, ["b"])[0] >= 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["com", "a.com", "b.a.com", "net"]), st.sampled_from(["", "/", "/x", "/x/", "/xy"]), st.sampled_from(["allow", "block"])), max_size=6, unique_by=lambda r: r[:2]), st.sampled_from(["a.com", "b.a.com", "xa.com", "net", "c.net"]), st.sampled_from(["", "/", "/x", "/x/y", "/xyz"]))
def test_longest_rule_wins(rules, host, path):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    whole = url_filter.sorted_table(h + p for h, p, _ in rules)
    hosts = url_filter.sorted_table(h for h, _, _ in rules)
    text = lambda t, j: t["strings"][t["ends"][j] : t["ends"][j + 1]].tobytes().decode()
    lengths = [sorted({len(p) for h, p, _ in rules if h == text(hosts, j)}) for j in range(len(hosts["digests"]))]
    verdicts = {h + p: v for h, p, v in rules}
    index = {f"rule_{k}": v for k, v in whole.items()} | {f"host_{k}": v for k, v in hosts.items()}
    index |= {"rule_allow": np.array([verdicts[text(whole, j)] == "allow" for j in range(len(whole["digests"]))], bool), "host_lengths": np.array([x for y in lengths for x in y], int), "host_length_ends": np.cumsum([0, *map(len, lengths)])}
    _, _, rule, verdict = url_filter.judge(index, [f"http://{host}{path}?q"], "allow")
    assert (rule[0], verdict[0]) == ((best[2], best[3]) if best else (None, "allow"))


# Substring dedup.


def slow_substring(rows, window=13):
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for a in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = {a + k for a in range(len(words) - window + 1) if i is not None and first[tuple(words[a : a + window])] < i for k in range(window)}
        out.append((str(i), len(words), len(gone)))
    return sorted(out)


@pytest.mark.parametrize(("hot", "shard", "segment"), [(2000, 400_000, 32), (1, 50, 2), (3, 1, 32)])
def test_substring_equals_brute_force(spark, monkeypatch, hot, shard, segment):
    """A passage in many documents among other words, repeats within documents, chains of few words."""
    for name, value in (("HOT", hot), ("SHARD", shard), ("SEGMENT", segment)):
        monkeypatch.setattr(substring, name, value)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3 if i % 7 == 0 else 5000, int(rng.integers(0, 80)))]
        if i % 2:
            a, b = sorted(rng.integers(0, 31, 2))
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage[a:b] * int(rng.integers(1, 3))
        texts.append(" \n".join(words))
    rows = [*enumerate(texts), *enumerate(ODD, 100), (None, texts[1]), (3, texts[5]), (3, texts[5])]
    got = substring.substring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == slow_substring(rows)


def test_without_repeats_keeps_columns_and_other_texts(spark):
    long = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{long}\nend  here", 1, "x"), (2, f"start\n{long}\nlast", 2, None), (3, long, 3, "y"), (None, None, None, "z")], "doc_id bigint, text string, n_chars bigint, _batch string")
    got = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert got[1].text == f"{long}\nend  here" and got[2].text == "start\nlast" and got[2].n_chars == 10 and 3 not in got
    assert got[None]._batch == "z" and got[1]._batch == "x" and got[1].n_chars == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=1, max_size=5), st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(1, 6))
def test_backward_search_counts(sequences, pattern, length):
    """Rows of a pattern are its occurrences; matching statistics of full length are exact."""
    arrays = [np.array(s) for s in sequences]
    index = fm_index.FMIndex(arrays, 3, length)
    count = lambda p: sum(s[i : i + len(p)] == p for s in sequences for i in range(len(s) - len(p) + 1))
    for n in range(1, len(pattern) + 1):
        low, high = index.search(np.array(pattern[-n:]))
        assert max(0, high - low) == count(pattern[-n:])
    sizes, lows, highs = (x[0] for x in index.matching_statistics([np.array(pattern)], length))
    for i in range(len(pattern)):
        longest = max((n for n in range(1, min(length, len(pattern) - i) + 1) if count(pattern[i : i + n])), default=0)
        assert sizes[i] == longest
        if longest:
            assert highs[i] - lows[i] == count(pattern[i : i + longest])


def test_index_is_compressed():
    """Less than half of the 24 bytes a symbol of text, suffix array and owners; the least value of each run is exact."""
    rng = np.random.default_rng(4)
    common = rng.integers(1, 20_000, 60)
    sequences = [np.concatenate([rng.integers(1, 20_000, 20), common[a : a + 30], rng.integers(1, 20_000, 20)]) for a in rng.integers(0, 30, 600)]
    values = rng.permutation(5000)[:600] - 100
    index = fm_index.FMIndex(sequences, 20_000, 13, values)
    assert index.nbytes - 16 * 20_000 < 12 * index.size
    sizes, lows, _ = (x[0] for x in index.matching_statistics([common], 13))
    for i in range(len(common) - 12):
        have = [v for v, s in zip(values.tolist(), sequences, strict=True) if any((s[j : j + 13] == common[i : i + 13]).all() for j in range(len(s) - 12))]
        assert (sizes[i] == 13) == bool(have)
        assert not have or index.least_value(lows[i : i + 1])[0] == min(have)


# WARC revisits.


def slow_revisits(rows):
    out = {}
    for rid, key, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and None not in (key, ts, r[1], r[2]) and r[1] == key and (r[2], r[0]) < (ts, rid)]
        if not before:
            out[rid] = ("no-earlier", None)
            continue
        old = max(before, key=lambda r: (r[2], r[0]))
        a, b = (({k.lower(): v for k, v in (h or {}).items()}) for h in (headers, old[4]))
        tag = lambda h: h["etag"].removeprefix("W/") if h.get("etag") else None
        if tag(a) and tag(b):
            ok = tag(a) == tag(b)
        else:
            ok = a["last-modified"] == b["last-modified"] if a.get("last-modified") and b.get("last-modified") else None
        out[rid] = ("unvalidated" if ok is None else "resolved" if ok else "mismatch", old[0])
    return out


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        key = None if i % 57 == 0 else "hot" if i % 3 else f"k{rng.integers(0, 20)}"
        headers = None if i % 31 == 0 else {"ETag": f"{'W/' if rng.random() < 0.3 else ''}\"{rng.integers(0, 2)}\""} if rng.random() < 0.6 else {"Last-Modified": f"d{rng.integers(0, 2)}"}
        rows.append((i, key, None if i % 41 == 0 else int(rng.integers(0, 200)), "response" if rng.random() < 0.4 else "revisit", headers))
    frame_ = spark.createDataFrame([(i, None if k is None else f"http://www.H.com:80/{k}/?utm_source=1#x", t, kind, h) for i, k, t, kind, h in rows], "record_id bigint, url string, ts bigint, kind string, headers map<string,string>")
    got = {r.record_id: (r.outcome, r.response_id) for r in warc.resolve(frame_).collect()}
    assert got == slow_revisits(rows)


def test_headers_merge_and_urls(spark):
    rows = [(1, "http://a.com/x?b=2&a=1", 1, "response", {"Content-Type": "t", "ETag": "e", "Date": "old"}), (2, "https://www.A.com/x/?a=1&utm_medium=q&b=2", 2, "revisit", {"etag": "W/e", "Date": "new", "Content-Length": "0"})]
    r = warc.resolve(spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, headers map<string,string>")).first()
    assert (r.outcome, r.response_id, r.headers) == ("resolved", 1, "content-type: t\ndate: new\netag: W/e")


# HTML.


def test_articles_of_all_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert html_extract.main_text(r.html) == text


LONG = "This is the first part of the article and it has a number of words that are in the language of the page."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain", ""), ("<article>Short.</article>", "Short."),
    (f"<body><header>Site of the name</header><nav><a href=x>Home</a></nav><p>{LONG}</p><p>Well.</p><p>{LONG}</p><footer>&copy; 2024</footer>", f"{LONG} Well. {LONG}"),
    (f"<main><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><section id=comments><article><p>{LONG}</p></article></section></main>", LONG),
    (f"<article><p>a&amp;b &lt;x&gt;<b>c</b>d<br>e</p><script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form>Sign in</form><p>{LONG}</article>", f"a&b <x>cd e {LONG}"),
    (f"<div class=ad>{LONG}<article><p>{LONG}", LONG),
    (f"<article>{LONG}<!-- never closed {LONG}", LONG),
])
def test_pages(page, text):
    assert html_extract.main_text(page) == text


# Licences.


def test_rules_take_whole_statements_first(spark):
    s = license_scan.SENTENCES
    mit = "\n".join(s[k] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    texts = [mit, s["mit-grant"], f"{s['bsd-grant']}\nother words\n{s['bsd-source']} {s['bsd-binary']}", "licensed UNDER the apache license version 2.0", None, "", "No licence of the kind.", f"{s['cc0']}\n{s['gpl3-short']}"]
    got = {r.doc_id: r.licences for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "", 2: "BSD-2-Clause", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "CC0-1.0,GPL-3.0"}


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * ", "-- "])
@pytest.mark.parametrize("end", ["\n", "\r\n", " \n"])
def test_wrapped_licences_are_found(spark, mark, end):
    import textwrap

    def notice(seq):
        return end.join((mark + line).rstrip(" ") if not line else mark + line for k in seq for line in textwrap.wrap(license_scan.SENTENCES[k], 72))

    rules = [r for r in license_scan.RULES if len(r[1]) > 1]
    texts = [f"Copyright 2020{end}{end}{notice(seq)}{end}{end}code" for _, seq in rules]
    first, *rest = textwrap.wrap(license_scan.SENTENCES["mit-notice"], 72)
    apart = [f"{first}{end}{mark.rstrip(' ')}{end}{end.join(rest)}", f"We say: not {first}{end}{end.join(rest)}", f"{first}{end}{end.join(rest)[:-1]} and more"]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in license_scan.license_scan(frame(spark, texts + apart)).collect()}
    assert got == {i: (",".join(seq), name) for i, (name, seq) in enumerate(rules)} | {len(rules) + i: ("", "") for i in range(len(apart))}


def test_native_operators_run_no_python(spark):
    from vecspark.llm import quality

    for df in (license_scan.op8_license_scan(spark, SF), quality.op10_quality(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Decontamination.


def slow_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y and x > 0 else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return int(table.max())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), min_size=1, max_size=12)), min_size=1, max_size=6))
def test_alignment_equals_the_table(pairs):
    got = decontaminate.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [slow_alignment(a, b) for a, b in pairs]


def test_edited_copies_are_found_and_clean_documents_left(spark):
    rng = np.random.default_rng(2)
    items = [[f"i{n}w{k}" for k in range(size)] for n, size in enumerate((10, 20, 40, 60))]
    texts, want = [], set()
    for n, words in enumerate(items):
        for share in (0, 0.1, 0.2):
            edited = [w if rng.random() >= share else f"e{rng.integers(0, 10**9)}" for w in words]
            if share and len(words) > 12:
                del edited[int(rng.integers(0, len(edited)))]
            if share and len(words) <= 12:
                edited = [*words[:6], "new", *words[7:]]
            other = [f"o{x}" for x in rng.integers(0, 10**6, 300)]
            at = int(rng.integers(0, 300))
            texts.append(" ".join(other[:at]).upper() + "\n" + " ".join(edited) + ", " + " ".join(other[at:]))
            want.add((len(texts) - 1, n))
    texts += [None, "", " ".join(f"o{x}" for x in rng.integers(0, 10**6, 2000)), " ".join(items[3][:8]), " ".join(items[2][:3] * 100)]
    docs = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame([*((n, " ".join(w).title()) for n, w in enumerate(items)), (9, None), (10, ""), (11, "two words")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, benchmark).collect()} == want
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_a_single_copy_with_spread_edits_is_found(spark):
    """Each item has one copy, whose edits leave only 3-grams that are as frequent as any or more."""
    edits = [lambda k, w: [f"e{k}"] if k % 4 == 3 else [w], lambda k, w: [f"e{k}"] if k % 5 == 4 else [w], lambda k, w: [f"e{k}"] if k % 6 == 5 else [w], lambda k, w: [w, f"e{k}"] if k % 3 == 2 else [w], lambda k, w: [w, *[f"e{x}" for x in range(25)]] if k == 20 else [w], lambda k, w: [w] if k < 22 else []]
    items = [[f"s{n}w{k}" for k in range(45)] for n in range(len(edits))]
    texts = [" ".join(x for k, w in enumerate(words) for x in edit(k, w)) for words, edit in zip(items, edits, strict=True)]
    docs = frame(spark, [f"some words before {t} and after" for t in texts] + ["some words before and after"])
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id bigint, text string")
    want = {(n, n): slow_alignment([k + 1 for k in range(45)], [int(x.split("w")[1]) + 1 if x[0] == "s" else 0 for x in t.split()]) for n, t in enumerate(texts)}
    assert min(want.values()) >= decontaminate.LEAST_SCORE * 2 * 45
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(docs, benchmark).collect()} == want
    assert [r.doc_id for r in decontaminate.clean(docs, benchmark).collect()] == [len(items)]


def aligned(texts, benchmark):
    """(place of the text, item_id, score) of every text and item whose whole alignment reaches the needed score."""
    index = decontaminate.Index(sorted(benchmark))
    numbers = decontaminate.Numbers(index.vocabulary)
    out = set()
    for n, t in enumerate(texts):
        words, _ = decontaminate.read(numbers, [(t or "").encode()])
        for i, score in enumerate(decontaminate.align(index.words, [words] * len(index.words)).tolist()):
            if len(index.words[i]) >= 3 and score >= index.need[i]:
                out.add((n, index.ids[i], score))
    return out


def test_all_texts_against_all_items(spark, monkeypatch):
    """The whole operator against full alignments of every text with every item: nothing is missing, nothing too much."""
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {(rows[n].doc_id, i, s) for n, i, s in aligned([r.text for r in rows], [tuple(r) for r in benchmark.select("item_id", "text").collect()])}
    found = lambda: {(r.doc_id, r.item_id, r.score) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert want and found() == want
    kept = {r.doc_id for r in rows} - {d for d, _, _ in want}
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == kept
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several blocks, and tables of few seeds
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert found() == want
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == kept


def test_templated_items_match_what_holds_them(spark):
    """Items that share most words: a text with their common words holds none of them."""
    items = [(n, f"what is the name of x{n}") for n in range(300)] + [(500, "what is the name of x7")]
    texts = ["what is the name of it " * 200, "well what is the name of x7 then", "what is the name of x7", None]
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[3])], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()), key=str)
    own = [7, 500]
    assert got == sorted([(d, i) for d in (None, 2, 2) for i in own], key=str)


# The pipeline.


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        assert out.count() <= seen.count(), name
        if name != "token_ids":
            assert out.columns == docs.columns
            path = token_output.new_path(spark, "stage")
            out.write.parquet(path)
            seen = spark.read.parquet(path)
    texts = {r.doc_id: r.text for r in sentencepiece_codec.decode(out.select("doc_id", "ids")).collect()}
    assert texts == {r.doc_id: r.text for r in seen.collect()}
