"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.llm import common, decontamination, exact_dedup, exchange, jaccard_join, lm_scoring, pii, quality_classifier, secret_scan, sentencepiece_bpe, spans, substring_dedup, trees, warc_bundles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, fragment int, score double, target int"


def sha(s):
    return hashlib.sha256((s or "").encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    """Copies, near copies, shared passages, awkward texts."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(900)] + ["é", "ünd", "日本", "x\x0cy", "A.B", "😀"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(60), text(200).split()
    rows = [text(rng.randint(0, 120)) for _ in range(60)]
    rows += [text(40) + " " + passage + "\n" + text(rng.randint(0, 30)) for _ in range(8)]
    for k in range(12):
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append(" ".join(near))
    rows += [rows[3].upper(), rows[3], rows[3], "", None, " \t\n", "a", "one two", "one  two", "tok " * 80, "q" * 5000, text(3000)]
    return [(i, t, "en", f"s{i % 3}", 0, "x", 7, 0.5, 1) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in corpus()}


@pytest.fixture(scope="module")
def bench(spark, texts):
    long = [t for t in texts.values() if t and len(t.split()) > 100]
    items = [(1, " ".join(long[0].split()[10:40])), (2, "one two"), (3, long[1][:200].upper()), (10, "zzzz not there at all anywhere in these texts ever"), (11, ""), (12, None), (2, "one TWO"), (13, " ".join(long[0].split()[12:24])), (14, " ".join(reversed(long[2].split()[20:31])))]
    return spark.createDataFrame(items, "item_id bigint, text string")


# --- exact dedup ---------------------------------------------------------------


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[(t or "").translate(LOW)].append(i)
    for history in (docs.where("doc_id % 2 = 0"), docs.where("false"), docs):
        incoming = docs.join(history.select("doc_id"), "doc_id", "left_anti")
        got = {r.doc_id: r for r in exact_dedup.dedup(history, incoming).collect()}
        assert len(got) == len(texts)
        for t, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), sha(t))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 2), dtype=np.uint64)
    levels = exact_dedup.unpack_levels(exact_dedup.pack_levels(exact_dedup.build_levels(keys)))
    assert sorted(exact_dedup.slots(keys, levels)) == list(range(n))


def test_exact_dedup_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(rows.where("false"), rows).collect()), key=str)
    assert got == [(-1, 1, 3, False), (-1, None, 1, True), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.keep_one(rows).collect()) == [(-1, "b"), (1, "a"), (2, "c")]


# --- SentencePiece ---------------------------------------------------------------


def test_sentencepiece_against_library(spark, docs, texts):
    model = sentencepiece_bpe.Model(sentencepiece_bpe.read_model(sentencepiece_bpe.default_model()))
    for r in sentencepiece_bpe.encode(docs, with_ids=True).collect():
        ids = [model.bos, *model.library.encode(texts[r.doc_id] or ""), model.eos]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == sha(model.library.decode(ids))
    for r in sentencepiece_bpe.token_rows(docs, sentencepiece_bpe.default_model()).collect():
        assert r.decoded == model.library.decode(r.ids)


def test_sentencepiece_checks_line_starts():
    """A wrong chunk at the start of a line, in a text that is not its slice's first, is found."""
    model = sentencepiece_bpe.Model(sentencepiece_bpe.read_model(sentencepiece_bpe.default_model()))
    own = model.chunk
    assert len(sentencepiece_bpe.encode_texts(model, ["plain", "one two\nthree\n\n\tfour \u2581 x\r\n\u00e9\U0001f600"])) == 2
    model.kept.clear()
    model.chunk = lambda c: own("wrong") if c == "Start" else own(c)
    with pytest.raises(ValueError, match="Start"):
        sentencepiece_bpe.encode_texts(model, ["plain", "one\nStart here"])


def test_sentencepiece_odd_strings():
    model = sentencepiece_bpe.Model(sentencepiece_bpe.read_model(sentencepiece_bpe.default_model()))
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("ab e\n\t▁ é日\U0001f600\x00<s>/.~ 東") for _ in range(rng.randint(0, 40)))
        ids = model.encode(t)
        assert ids == [model.bos, *model.library.encode(t), model.eos]
        assert model.decode(ids) == model.library.decode(ids)
    ids = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(4000)]
    for k in range(0, 4000, 10):
        assert model.decode(ids[k : k + 10]) == model.library.decode(ids[k : k + 10])


# --- Jaccard join ------------------------------------------------------------------


def shingles(t, k):
    w = words((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if w else frozenset()


def linked(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(docs, texts, k, num):
    sets, component = linked(texts, k, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, num, 100).collect()}
    assert got == {i: (len(sets[i]), component[i]) for i in texts}
    assert len(set(component.values())) < len(texts) - 4


def test_jaccard_links_are_complete(spark, monkeypatch):
    """Sets that all link with one another count each other; blocks of 4 split the hot shingles."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    body = [f"w{j}" for j in range(200)]
    texts = {i: " ".join([*body[: i % 15], f"x{i}", *body[i % 15 + 1 :]]) for i in range(1, 31)} | {40: " ".join(body), 41: " ".join(body), 50: "quite another text of its own", 51: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sets, component = linked(texts, 3, 90, 100)
    distinct = set(sets.values())
    want = {i: (component[i], sum(s != t and bool(s and t) and 100 * len(s & t) >= 90 * len(s | t) for t in distinct)) for i, s in sets.items()}
    assert want[1][1] > 20 and want[40] == want[41] and want[50][1] == want[51][1] == 0
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in jaccard_join.connected(docs).collect()} == component


def test_jaccard_query_counts_links(spark, tmp_path, monkeypatch):
    """The query has every link of every row: within blocks, across them, between sets that other links connect already."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = random.Random(7)
    body = [f"w{j}" for j in range(120)]
    texts = {i: " ".join([*body[: (a := rng.randrange(118))], f"x{i % 9}", *body[a + 1 :]]) for i in range(40)}
    texts |= {100 + i: " ".join([f"t{j}" for j in range(60 + i)]) for i in range(12)} | {200: texts[3], 201: "", 202: None, 203: "alone it is"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets, component = linked(texts, 3, 90, 100)
    distinct = set(sets.values())
    want = {i: (component[i], sum(s != t and bool(s and t) and 100 * len(s & t) >= 90 * len(s | t) for t in distinct)) for i, s in sets.items()}
    assert len({n for _, n in want.values()}) > 5
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.query(spark, str(tmp_path)).collect()} == want


def rows_of_joins(spark, after):
    """The most rows that a join of an execution later than `after` made, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    done, most, last = store.executionsList(), 0, after
    for k in range(done.size()):
        at = done.apply(k).executionId()
        last = max(last, at)
        if at > after:
            values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, last


def test_keep_one_makes_no_rows_by_pairs(spark):
    """Groups that share most shingles, rare ones too, but don't link: no join makes more rows than the sets have shingles."""
    body = [f"w{j}" for j in range(152)]
    texts = {}
    for i in range(300):
        own = list(body)
        own[70 + 3 * (i % 13)] = own[111 + 3 * (i % 13)] = f"x{i % 13}"
        texts[i] = " ".join([*own, f"y{i}"])
        # Makes what the groups differ in more frequent than what they share.
        texts[1000 + i] = " ".join([*body[66:], f"z{i}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sets, component = linked(texts, 5, 80, 100)
    before = rows_of_joins(spark, -1)[1]
    assert {r.doc_id for r in jaccard_join.keep_one(docs, 5, 80, 100).collect()} == set(component.values())
    most, last = rows_of_joins(spark, before)
    assert len(set(component.values())) == 14 and last > before
    assert 0 < most <= sum(map(len, sets.values()))


def test_segments_are_cut_alike(spark):
    """A shingle is in the same fragment of every list, whatever its place there."""
    rng = random.Random(5)
    order = sorted((rng.randrange(2, 60), rng.randrange(-(2**63), 2**63)) for _ in range(200))
    lists = [(i, 90, 0, [order[j] for j in sorted(rng.sample(range(200), 90))]) for i in range(6)]
    df = spark.createDataFrame(lists, "rep bigint, n bigint, lone bigint, s array<struct<c: bigint, h: bigint>>")
    cuts = jaccard_join.pivots(df)
    rows = jaccard_join.segments(df, cuts).collect()
    fragment = {}
    for r in rows:
        for h in r.seg:
            assert fragment.setdefault(h, r.f) == r.f
    assert len(cuts) == 7 and set(fragment.values()) == set(range(8))
    for i, _, _, s in lists:
        mine = sorted((r for r in rows if r.rep == i), key=lambda r: r.f)
        assert [h for r in mine for h in r.seg] == [h for _, h in s]
        assert all(r.ahead + len(r.seg) + r.behind == 90 for r in mine)


def test_tile_overlaps(monkeypatch):
    """By products of matrices or by pairs, in chunks of any size."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        for name in ("COLUMNS", "DENSE", "PAIRS"):
            monkeypatch.setattr(jaccard_join, name, int(rng.integers(1, 200)))
        a, b = ([rng.permutation(60)[: rng.integers(0, 40)] for _ in range(rng.integers(1, 20))] for _ in range(2))
        for right in (a, b):
            want = np.array([[len(set(p) & set(q)) for q in right] for p in a])
            got = jaccard_join.tile_overlaps(a, None if right is a else b)
            assert (got == (np.triu(want, 1) if right is a else want)).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    root = {}
    for a, b in edges:
        root.setdefault(a, {a})
        root.setdefault(b, {b})
        if root[a] is not root[b]:
            root[a] |= root[b]
            for x in root[b]:
                root[x] = root[a]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: min(s) for x, s in root.items() if len(s) > 1}


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes, others don't, at any place and across blocks."""
    rng = random.Random(1)
    texts = [b"", b" \t\n", b"a", b"one two  three\x0cfour\x0b", b"x" * 200 + b" y", b" ".join(b"q" * n for n in range(55, 70))]
    texts += [" ".join("".join(rng.choice("ab\u00e9\u65e5Z") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 50))).encode() for _ in range(100)]
    for block in (64, 1 << 15):
        monkeypatch.setattr(common, "HASH_BLOCK", block)
        common._block_powers.cache_clear()
        hashes, counts = common.word_hashes(texts, common.LOWER_TABLE)
        found = [t.translate(common.LOWER_TABLE).split() for t in texts]
        assert counts.tolist() == [len(w) for w in found]
        pairs = set(zip((w for ws in found for w in ws), hashes.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    common._block_powers.cache_clear()


@pytest.mark.parametrize("two_levels", [False, True])
def test_exchange(spark, monkeypatch, two_levels):
    """Sums over all slices equal those made at once, also by way of coarse fragments and blocks."""
    rng = np.random.default_rng(0)
    sent = {i: np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64) >> np.uint64(0))[:50] for i in range(12)}
    common_ = rng.integers(0, 2**64, 20, dtype=np.uint64)
    sent = {i: np.concatenate([h, rng.choice(common_, 8), common_[:2]]) for i, h in sent.items()}
    deal = exchange.Deal(100, 12)
    if two_levels:
        deal.n, deal.direct, deal.blocks = 12, 4, 3
    for kind, narrow in ((deal.marks(32), 32), (exchange.Counts(2), 48)):
        batches = [exchange.Dealt(deal, h, kind, narrow).rows(i, np.stack([np.ones(len(h), np.int64), h.astype(np.int64) % 3]) if kind.rows == 2 else None) for i, h in sent.items()]
        rows = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], exchange.SQL).repartition(3)
        replies = defaultdict(dict)
        for r in exchange.exchange(rows, deal, kind).collect():
            replies[r.source][r.fragment] = bytes(r.body)
        total = Counter(v for h in sent.values() for v in h.tolist())
        for i, h in sent.items():
            sums = exchange.Dealt(deal, h, kind, narrow).sums(replies[i])
            if kind.rows == 1:
                assert ((sums[0] > 1) == [total[v] > 1 for v in h.tolist()]).all()
            else:
                assert sums[0].tolist() == [total[v] for v in h.tolist()] and sums[1].tolist() == [total[v] * (int(np.uint64(v).astype(np.int64)) % 3) for v in h.tolist()]


def test_exchange_rows_are_linear():
    """Twice the input has twice the slices, each with as many rows: no more than WIDTH however many fragments there are."""
    hashes = np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64)
    rows = [exchange.Dealt(d := exchange.Deal(features, 10), hashes, d.marks(32), 32).rows(0).num_rows for features in (1e10, 1e12)]
    assert max(rows) <= exchange.WIDTH


# --- decontamination ---------------------------------------------------------------


def test_decontamination(docs, bench, texts):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = [(r.item_id, tokens(r.text)) for r in bench.collect()]
    found = decontamination.report(decontamination.find(docs, bench, span=20))
    got = {r.doc_id: r for r in found.collect()}
    hits = close = 0
    for i, t in texts.items():
        w, hit, seen = tokens(t), set(), set()
        for item, x in items:
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    seen.add(str(item))
        hits += len(hit)
        stretch = [set(w[k : k + 20]) for k in range(max(len(w) - 19, 1))]
        near = {str(item) for item, x in items if (n := min(10, len(x))) and any(set(x[k : k + n]) <= s for k in range(len(x) - n + 1) for s in stretch)}
        close += len(near - seen)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated, got[i].n_near) == (len(w), len(hit), len(seen), sha(",".join(sorted(seen))), bool(hit), len(near))
    assert hits > 50 and close > 0


def test_decontamination_in_blocks(docs, bench, monkeypatch):
    whole = sorted(map(tuple, decontamination.report(decontamination.find(docs, bench, span=20)).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontamination, "MOST_ENTRIES", 5)
    assert sorted(map(tuple, decontamination.report(decontamination.find(docs, bench, span=20)).collect()), key=str) == whole


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "a x b y c"), (2, "c far far far far far far a b"), (3, "b a c a"), (4, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, decontamination.proximity(rows, ["A b c"], 5).collect()))
    assert got == [(1, "A b c", 0, 5), (3, "A b c", 0, 3)]


# --- substring dedup ---------------------------------------------------------------


@pytest.mark.parametrize(("window", "period", "cover"), [(35, 21, (0, 1, 4, 14, 16)), (8, 7, (0, 1, 3)), (4, 3, (0, 1))])
def test_substring_dedup(docs, texts, window, period, cover):
    starts = Counter()
    for t in texts.values():
        w = words(t)
        starts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    removed = 0
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, window, period, cover, with_text=True).collect()}
    for i, t in texts.items():
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].kept_sha256) == (len(w), len(gone), kept, sha(kept))
    assert removed > 300


def test_cover_is_checked(docs):
    with pytest.raises(ValueError, match="cover"):
        substring_dedup.remove_repeats(docs, 35, 21, (0, 1, 2))


# --- WARC --------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rng = random.Random(2)
    bodies = ["x" * 99, "y" * 100, "é" * 50, "", None] + ["".join(rng.choice("<>abc \r\n") for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    rows = [(i, f"http://h/%0a {i}\r\né", rng.choice(bodies), "clash") for i in range(200)] + [(None, None, "y" * 100, ""), (5, "again", "y" * 100, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    bundles = warc_bundles.write_bundles(warc_bundles.plan_records(pages), 4096, 20_000).cache()
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted(((i, u or "", len((h or "").encode()), sha(h)) + (("revisit", first[h]) if first.get(h, i) != i else ("response", None)) for i, u, h, _ in rows), key=str)
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.read_bundles(bundles).collect()), key=str)
    assert got == want
    body = {i: h for i, _, h, _ in rows[:200]}
    asked = spark.createDataFrame([(7,), (150,)], "page_id bigint")
    for r in warc_bundles.fetch(bundles, asked).collect():
        assert r.record_type == "revisit" or bytes(r.block).split(b"\r\n\r\n", 1)[1] == (body[r.page_id] or "").encode()
    for r in bundles.collect():
        table = warc_bundles.seek_table(r.data)
        assert len(table) == max(r.frames) + 1 and all(len(warc_bundles.read_frame(r.data, table, k)) == table[k][2] for k in range(len(table)))


def test_warc_export(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "body")], "page_id bigint, url string, html string")
    (row,) = warc_bundles.export(warc_bundles.write_bundles(warc_bundles.plan_records(pages)), tmp_path.as_uri()).collect()
    data = (tmp_path / row.path.rsplit("/", 1)[1]).read_bytes()
    assert len(data) == row.bytes and warc_bundles.seek_table(data)


# --- quality classifier ------------------------------------------------------------


def test_quality_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(rng.randint(20, 150))) + "."
    bad = lambda: rng.choice([lambda: f"{word()} " * 60, lambda: " ".join(word().upper() + "!!" for _ in range(50)), lambda: " | ".join(word() for _ in range(40))])()
    rows = [(i, good() if i % 4 else bad(), i % 4 > 0) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows] + [(None, 1), (9999, 0), (3, None)], "doc_id bigint, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 1202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    kept = quality_classifier.keep_good(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    none = quality_classifier.classify(docs.limit(5), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_ridge_equals_a_direct_fit(spark):
    """The partitions' summed normal equations give the weights of all rows at once."""
    rng = random.Random(8)
    texts = {i: " ".join("".join(rng.choice("abcdeXY1!") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 60))) for i in range(400)}
    y = {i: rng.random() < 0.6 for i in texts}
    labels = spark.createDataFrame([(i, int(v)) for i, v in y.items()], "doc_id bigint, quality int")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    model = quality_classifier.fit(quality_classifier.labelled(quality_classifier.document_statistics(docs), labels))
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    seen = [i for i in texts if fold[i]]
    x = quality_classifier.statistics([texts[i].encode() for i in seen])
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    rng2 = np.random.default_rng(quality_classifier.SEED)
    frequency = rng2.normal(0, 1 / quality_classifier.WIDTH, (x.shape[1], quality_classifier.FEATURES))
    phase = rng2.uniform(0, 2 * np.pi, quality_classifier.FEATURES)
    z = np.hstack([np.sqrt(2 / quality_classifier.FEATURES) * np.cos(np.clip((x - mean) / scale, -6, 6) @ frequency + phase), np.ones((len(x), 1))])
    learn = np.array([fold[i] > 1 for i in seen])
    target = np.array([float(y[i]) for i in seen])
    a = z[learn]
    weights = np.linalg.solve(a.T @ a + quality_classifier.PENALTY * len(a) * np.eye(a.shape[1]), a.T @ target[learn])
    assert np.allclose(model.mean, mean) and np.allclose(z @ model.weights, z @ weights, atol=1e-6)


def test_isotonic():
    rng = np.random.default_rng(1)
    w, v = rng.random(60) + 0.1, rng.random(60)
    fit = quality_classifier.isotonic(w, v)
    assert (np.diff(fit) >= -1e-12).all() and abs((w * fit).sum() - (w * v).sum()) < 1e-9
    best = (w * (fit - v) ** 2).sum()
    for _ in range(300):
        other = np.sort(fit + rng.normal(0, 0.05, 60))
        assert (w * (other - v) ** 2).sum() >= best - 1e-9


# --- PII and secrets ---------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if good() else []
    return out


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.default_model(spark)


def test_pii_base_spans(spark, pii_model):
    rng = random.Random(9)
    bits = ["a", "b.c", "@", ".", "x@y.z", "1.2.3.4", "999.1.1.1", "0001.2.3.255.6", " ", "-", "+1 (569) 555-7279", "4111 1111 1111 1111", "4111111111111112", "+", "5", "é", "😀", "%", "\n", "()", "12", "00"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1500)] + [(2000, None), (2001, "9" * 20000), (2002, "a" * 20000 + "@"), (2003, "1 " * 9000), (2004, "+1" + "(" * 9000)]
    got = pii.report(pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), *pii_model)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(want)), texts[r.doc_id][:200]
        assert Counter(x.split(":")[0] for x in want) == Counter({k: getattr(r, f"n_{k}") for k in PII if getattr(r, f"n_{k}")})
        spans_ = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans_) and len(spans_) == r.n_spans == len(want) + r.n_added
        # What is added meets neither a base span nor another added one.
        places = lambda some: [tuple(map(int, x.split(":")[1:])) for x in some]
        added = places(set(spans_) - set(want)) if r.n_added else []
        assert all(e <= a or b <= s for s, e in added for a, b in [*places(want), *added] if (a, b) != (s, e))


def test_pii_added_spans(spark, pii_model):
    rows = [(1, "mail me bob(at)example.com now"), (2, "tel: (212) 555-0199 x"), (3, "born at home.The end"), (4, "version 10.11.2024 of it"), (5, "social security 123-45-6789 ok")]
    found = pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), *pii_model).cache()
    assert {r.doc_id: r.n_added for r in pii.report(found).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert {r.doc_id: r.text for r in pii.redact(found).collect()}[1] == "mail me [EMAIL] now"


@pytest.fixture(scope="module")
def language(spark):
    return secret_scan.language(spark.createDataFrame([(i, "this that with from there other password settle version build") for i in range(3)] + [(9, None)], "doc_id bigint, text string"))


def test_secret_scan(spark, language):
    made = secret_scan.made_findings(language.words, 2400)
    rows = spark.createDataFrame(made, secret_scan.FINDINGS)
    forest = secret_scan.fit(rows.where("crc32(cast(match as binary)) % 4 <> 0"), language)
    held = [m for m in made if zlib.crc32(m[1].encode()) % 4 == 0]
    docs = spark.createDataFrame([(i, m[0] + m[1] + m[2], m[3]) for i, m in enumerate(held)] + [(-1, None, None), (-2, "", "")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.report(secret_scan.scan(docs, forest, language)).collect()}
    right = sum((got[i].n_secrets > 0) == bool(m[4]) for i, m in enumerate(held))
    assert right / len(held) > 0.93 and got[-1].n_candidates == got[-2].n_candidates == 0


def test_secret_candidates(spark, language):
    """Names aren't part of values; values of other signs and key blocks are found; every span is what it says it is."""
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc/+\n-----END RSA PRIVATE KEY-----"
    texts = {1: "export API_TOKEN=ghp_" + "a1B2" * 9, 2: "password: s3cr!t?x, y", 3: f"x {key} y", 4: "MY_VERY_LONG_SECRET_NAME=" + "Zx9" * 8 + "== z", 5: "nothing here", 6: "token = \"ab\""}
    want = {1: ["ghp_" + "a1B2" * 9], 2: ["s3cr!t?x"], 3: [key], 4: ["MY_VERY_LONG_SECRET_NAME", "Zx9" * 8 + "=="], 5: [], 6: []}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("path", F.lit(""))
    for r in rows.withColumn("c", secret_scan.candidates(F.col("text"))).collect():
        assert [texts[r.doc_id][c.start : c.end] for c in r.c] == [c.m for c in r.c] == want[r.doc_id]
    coverage = {r.doc_id: r.described[0].f[secret_scan.FEATURES.index("coverage")] for r in secret_scan.described(spark.createDataFrame([(1, "thisthatotherfrom"), (2, "qzqzqzqzqzqzqzqz"), (3, "xthisxxxxxxxxxxx")], "doc_id bigint, text string").withColumn("path", F.lit("")), language).collect()}
    assert coverage == {1: 1.0, 2: 0.0, 3: 0.25}


def test_pii_many_matches(spark, pii_model):
    """A text of very many matches: spans and counts hold, in time that its length explains."""
    n = 20_000
    r = pii.report(pii.detect(spark.createDataFrame([(1, "a@b.co x " * n)], "doc_id bigint, text string"), *pii_model)).collect()[0]
    assert r.n_email == n and r.base_sha256 == sha(",".join(f"email:{9 * i}:{9 * i + 6}" for i in range(n)))


def test_blocks_of_spans(spark):
    rng = random.Random(6)
    for size in (0, 1, 127, 128, 129, 400):
        text = "".join(rng.choice(["ab", "c", "\u00e9\U0001f600"]) for _ in range(size))
        row = spark.createDataFrame([(text,)], "t string").select(spans.find(F.col("t"), "k", "ab|\U0001f600").alias("s")).collect()[0]
        assert [(s.start, s.end) for s in row.s] == [m.span() for m in re.finditer("ab|\U0001f600", text)]
    some = [(a := rng.randrange(3000), a + rng.randrange(1, 6)) for _ in range(300)]
    row = spark.createDataFrame([([{"start": a, "end": b} for a, b in some],)], "x array<struct<start:int,end:int>>")
    got = row.select(spans.let(spans.bounded(F.col("x")), lambda taken: F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: spans.overlapping(taken, F.struct(i.alias("start"), (i + 2).alias("end"))))).alias("o")).collect()[0].o
    assert got == [any(a < i + 2 and i < b for a, b in some) for i in range(3001)]


def test_tree_sql_equals_python(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    for model in (trees.random_forest(x, y, trees=5), trees.gradient_boosting(x, y, trees=8)):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, f array<double>")
        got = np.array([r.s for r in rows.select("i", F.expr(model.sql("f")).alias("s")).orderBy("i").collect()])
        assert np.allclose(got, model.predict(x)) and ((got > 0.5) == y).mean() > 0.9


def test_dictionary(spark):
    rows = spark.createDataFrame([("word", 2), ("zebra", 1), ("other", 2), ("abc", 9)], "word string, n bigint")
    assert [r.word for r in secret_scan.dictionary(rows, 2).collect()] == ["other", "word"]


# --- LM scoring --------------------------------------------------------------------


@pytest.mark.parametrize("good", [{3, 6, 9, 60, 61, 1003}, set()])
def test_lm_scoring(spark, docs, texts, good):
    """Against dense models over every word; without a target both models are uniform in it."""
    many = {1000 + i: " ".join(f"w{(7 * i + j) % 700}" for j in range(40)) for i in range(100)}
    all_ = {**texts, **many}
    more = docs.select("doc_id", "text").union(spark.createDataFrame([*many.items(), (None, "w1 w2")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, 1) for i in good] * 2 + [(i, 0) for i in all_] + [(None, 1), (77_777, 1)], "doc_id bigint, quality int")
    tokens = [(i, words((t or "").translate(LOW))) for i, t in [*all_.items(), (None, "w1 w2")]]
    size = len({w for _, t in tokens for w in t}) + 2
    pair, context, single = ([Counter(), Counter()] for _ in range(3))
    for i, t in tokens:
        for row in [0, 1] if i in good else [0]:
            pair[row].update(zip([None, *t], t))
            context[row].update([None, *t][: len(t)])
            single[row].update(t)
    total = [sum(c.values()) for c in single]
    to = total[1] or total[0]

    def loss(row, a, b):
        one = (single[row][b] * (to / total[row] if total[row] else 0) + lm_scoring.ADDED) / ((to if total[row] else 0) + lm_scoring.ADDED * size)
        return -np.log(lm_scoring.BIGRAM * pair[row][a, b] / context[row][a] + (1 - lm_scoring.BIGRAM) * one if context[row][a] else one)

    got = lm_scoring.cross_entropy_difference(more, labels).collect()
    assert len(got) == len(tokens)
    by_id = {r.doc_id: r for r in got}
    for i, t in tokens:
        r = by_id[i]
        assert r.n_tokens == len(t)
        want = [np.mean([loss(row, a, b) for a, b in zip([None, *t], t)]) for row in (0, 1)] if t else None
        assert (r.score is None) if not t else np.allclose([r.background_loss, r.target_loss, r.score], [*want, want[1] - want[0]], atol=2e-4)


# --- awkward tables ----------------------------------------------------------------


def test_empty_tables(spark, docs, bench, pii_model):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    known = secret_scan.language(none)
    forest = secret_scan.fit(spark.createDataFrame(secret_scan.made_findings([], 200), secret_scan.FINDINGS), known)
    for out in (
        exact_dedup.dedup(none, none), exact_dedup.keep_one(none), sentencepiece_bpe.encode(none), jaccard_join.join(none), decontamination.find(none, bench), substring_dedup.remove_repeats(none), quality_classifier.classify(none, labels),
        lm_scoring.cross_entropy_difference(none, labels), quality_classifier.keep_good(none, labels), jaccard_join.keep_one(none, 5, 80, 100), pii.detect(none, *pii_model), secret_scan.scan(none, forest, known), warc_bundles.read_bundles(warc_bundles.write_bundles(warc_bundles.plan_records(pages))),
    ):
        assert out.count() == 0
    assert decontamination.find(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "other text here for once"), (2, "g")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect())
    assert got == Counter({(None, 4, 1): 2, (None, 0, None): 1, (1, 4, 1): 1, (1, 3, 1): 1, (2, 1, 2): 1})
    assert substring_dedup.remove_repeats(rows).count() == sentencepiece_bpe.encode(rows).count() == 6
    one = jaccard_join.keep_one(rows, 3, 90, 100)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter({(None, None): 1, (1, "a b c d e f"): 1, (1, "other text here for once"): 1, (2, "g"): 1})


def test_null_ids_link(spark):
    """Rows without an id link like others; a group of them alone keeps one row."""
    body = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*body[:k], "x", *body[k + 1 :]])
    rows = spark.createDataFrame([(None, near(0)), (5, near(59)), (None, "z " * 3 + near(30)), (None, "apart a b c"), (None, "apart a b c")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.join(rows, 3, 80, 100).collect())
    assert got == Counter({(None, 5): 2, (5, 5): 1, (None, None): 2})
    assert Counter(r.doc_id for r in jaccard_join.keep_one(rows, 3, 80, 100).collect()) == Counter({5: 1, None: 1})


def test_template_of_many_classes(spark, monkeypatch):
    """A passage that many sets share, which don't link, in cells of a few classes each."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    shared = [[f"p{j}q{i}" for i in range(12)] for j in range(40)]
    texts = {i: " ".join(w for j in sorted(random.Random(i).sample(range(40), 6)) for w in shared[j]) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    _, component = linked(texts, 3, 90, 100)
    assert {r.doc_id: r.component_id for r in jaccard_join.connected(docs).collect()} == component


#: Names that the operators use inside.
CLASHES = ("_own", "_n", "_id", "_sha", "_kept", "_gone", "id", "sha", "stays", "row", "own", "digest", "component", "n", "best", "source", "fragment", "body", "score", "stats", "group_size", "kept", "keep_id", "items", "c0", "c1", "rep", "h")


def test_clashing_names(spark, bench):
    """All stage forms keep a table's further columns as they are, whatever their names."""
    base = [(i, t) for i, t, *_ in corpus()]
    docs = spark.createDataFrame(base, "doc_id bigint, text string").select("doc_id", "text", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i, _ in base], "doc_id bigint, quality int")
    for out in (exact_dedup.keep_one(docs), jaccard_join.keep_one(docs, 5, 80, 100), decontamination.keep_clean(docs, bench), quality_classifier.keep_good(docs, labels)):
        rows = out.collect()
        assert out.columns == docs.columns and 10 < len(rows) <= len(base)
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES) and all(r.text == dict(base)[r.doc_id] for r in rows)
