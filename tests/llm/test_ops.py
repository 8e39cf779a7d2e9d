"""Corpus operators against brute force, and on nulls, empty and repeated rows, empty tables, clashing columns."""

import hashlib
import html.parser
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemill.llm import decontaminate, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, token_files, warc  # noqa: E402
from tidemill.llm.components import components  # noqa: E402
from tidemill.llm.tokens import Encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
#: Nulls, empty and blank texts, ties, repeated rows, one long text.
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
EDGE = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \n\t "), (None, "token = abcdef12"), (None, None), (5, "a b c"), (6, LONG), (7, "x\ny\nx\ny")]


def query(spark, name):
    return {r["doc_id"]: r for r in __spark_entry__.queries()[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", "s", 0, "extra", 1, "row", "h") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, tie int, rank string, block string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


MORE_SECRETS = {
    "private_key": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": re.compile("gh[pousr]_[A-Za-z0-9]{36}"),
    "slack": re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile("AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}


def test_op1_spans(spark, texts, edge, empty):
    got = query(spark, "op1_secret_scan")
    rules = {
        "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    for d, text in texts.items():
        spans = sorted((m.start(), k, m.end(), name) for k, (name, (rx, g, n)) in enumerate(rules.items()) for m in rx.finditer(text) if len(m[g]) >= n)
        want = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert all(got[d][f"n_{name}"] == sum(s[3] == name for s in spans) for name in rules)
        every = sorted([*spans, *((m.start(), 3 + k, m.end(), name) for k, (name, rx) in enumerate(MORE_SECRETS.items()) for m in rx.finditer(text))])
        assert got[d]["spans"] == ",".join(f"{name}:{a}:{b}" for a, _, b, name in every)
    found = secret_scan.find_secrets(edge).collect()
    assert len(found) == len(EDGE) and sum(len(r["spans"]) for r in found) == 1
    assert secret_scan.find_secrets(empty).count() == 0


def test_op1_queries_lose_nothing():
    """Any match holds the trigrams that its rule's query names."""
    samples = {"assign": "PassWord = 'abcdef'", "access": "AKIA" + "A1" * 10, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a" * 36, "slack": "xoxb-1234567890ab", "google": "AIza" + "b" * 35, "jwt": "eyJaaaaaaaa.bbbbbbbbb.ccccccccc"}
    for rule in secret_scan.RULES:
        q = secret_scan.trigram_query(rule)
        if rule.kind == "hex":
            assert q == secret_scan.ALL
            continue
        text = samples[rule.kind]
        assert re.search(rule.pattern, text, rule.flags)
        low = text.encode().lower()
        assert any(all(g in low for g in option) for option in q) and q != secret_scan.ALL


def test_op2_scores(spark, edge, empty):
    rows = __spark_entry__.queries()["op2_quality_classifier"](spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = (np.array([s for s, y, _ in held if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.93
    assert np.mean([p == y for _, y, p in held]) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1), (7, 0), (2, None)], "doc_id long, quality int")
    model = quality_classifier.train(edge, labels)
    scored = quality_classifier.score(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scored)
    import zstandard

    def size(dictionary, text):
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made.compress(text[i : i + 2048])) for i in range(0, len(text), 2048))

    for r, (_, t) in zip(sorted(scored, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(EDGE, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        text = (t or "").encode()
        good_size, bad_size = size(model.good, text), size(model.bad, text)
        x = (bad_size - good_size) / (good_size + bad_size) if text else 0.0
        w = model.weights
        if r["doc_id"] is not None:  # texts of the null id come in any order
            assert abs(r["score"] - 1 / (1 + np.exp(-(w[0] + w[1] * x + w[2] * x * min(1, len(text) / 2048))))) < 1e-9
    none = quality_classifier.train(empty, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(edge, none).collect()} == {0.5}
    assert quality_classifier.score(empty, none).count() == 0


def contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_op3_windows(spark, texts, edge, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = query(spark, "op3_decontamination")
    want = contamination(texts, items)
    assert {d: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for d, r in got.items()} == want
    assert any(r["contaminated"] for r in got.values())
    short = spark.createDataFrame([(1, "b"), (2, "A b"), (2, "A b"), (3, ""), (4, None), (None, "a")], "item_id long, text string")
    for size in (decontaminate.BLOCK_WINDOWS, 1):
        found = decontaminate.find_contamination(edge, short, block_windows=size).where("doc_id = 1").collect()
        assert [(r["n_words"], [tuple(h) for h in r["hits"]], r["items"]) for r in found] == [(3, [(0, 2)], ["1", "2"])] * 2
    assert decontaminate.find_contamination(edge, short.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.find_contamination(empty, short).count() == 0


def test_op4_sequences(spark, texts, edge, empty):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = __spark_entry__.queries()["op4_packing"](spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        want = [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    total = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(sequences) <= 1.01 * -(-total // 2048) + 1
    packed = packing.pack_documents(edge, P.path("word_bpe_49k.json")).collect()
    want = Counter()
    for i, t in EDGE:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def triplets(n, seed, capacity=2048):
    """Sizes that fill ``n`` bins exactly, three a bin."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(780, 1000))
        b = int(rng.integers(520, capacity - a - 515))
        out += [a, b, capacity - a - b]
    return np.array(out)


def test_op4_evolution_beats_best_fit_decreasing(spark):
    """Triplets, on which best-fit decreasing wastes bins: crossovers gain over their seeds and over it, migration over one epoch."""
    sizes = triplets(60, 5)
    plain: list = []
    packing.best_fit(sizes, list(range(len(sizes))), plain, [], 2048)
    seeds = packing.evolve(sizes, [], 7, 0, 2048)
    grown = packing.evolve(sizes, [], 7, 60, 2048)
    assert len(grown) < len(seeds) < len(plain) and sorted(i for b in grown for i in b) == list(range(len(sizes)))
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "id int, length long")
    used = {e: packing.pack(pieces, islands=3, epochs=e, generations=20).select("sequence_id").distinct().count() for e in (1, 3)}
    assert used[3] <= used[1] < len(plain)


def test_op4_crossover_keeps_every_item():
    sizes = np.random.default_rng(3).integers(1, 900, 300)
    best = packing.evolve(sizes, [], 1, 6, 2048)
    assert sorted(i for b in best for i in b) == list(range(300))
    assert max(sizes[b].sum() for b in best) <= 2048
    assert len(best) <= -(-sizes.sum() // 2048) + 1


def test_op5_counts(spark, texts, edge, empty):
    for d, r in query(spark, "op5_quality_rules").items():
        words = SPACED.findall(texts[d])
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in texts[d].split("\n") if SPACED.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in texts[d]), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])
    found = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(edge).collect()}
    assert {(k, r["base_failed"]) for k, r in found.items()} == {((i, len(SPACED.findall(t or ""))), i != 6) for i, t in EDGE}
    assert not any(r["kept"] for (i, _), r in found.items() if i != 6) and found[7, 4]["n_dup_lines"] == 2
    assert quality_rules.quality_rules(empty).count() == 0


def test_op5_common_words(spark):
    """Histograms of common words, in one count pass."""
    text = "The the und der La of, of tHe als Für für nicht " * 7
    row = quality_rules.document_counts(spark.createDataFrame([(1, text, "en"), (2, None, None)], "doc_id long, text string, lang string")).orderBy("id").collect()
    seen = Counter(w.lower() for w in text.split())
    assert row[0]["common"] == [*(seen[v] for v in quality_rules.VOCABULARY), sum(n for w, n in seen.items() if w not in quality_rules.VOCABULARY)]
    assert row[1]["common"] == [0] * (len(quality_rules.VOCABULARY) + 1) and all(len(w) >= 20 for w in quality_rules.COMMON_WORDS.values())


def test_op5_distance(spark):
    ref = [0.5, 0.3, 0.2]
    p = np.array([0.1, 0.0, 0.9])
    m = (p + ref) / 2
    want = np.sqrt(sum(0.5 * x * np.log2(x / y) for q in (p, ref) for x, y in zip(q, m) if x > 0))
    row = spark.createDataFrame([(p.tolist(),)], "p array<double>").select(quality_rules.js_distance(F.col("p"), ref)).first()
    assert abs(row[0] - want) < 1e-12


def test_op6_round_trip(spark, texts, edge, empty, tmp_path):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, at = query(spark, "op6_token_files"), 0
    for d in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = f"file://{tmp_path}/edge"
    token_files.write_token_files(edge, P.path("byte_bpe_50k.json"), path)
    back = token_files.read_token_files(spark, path).collect()
    want = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in EDGE]
    assert Counter((r["doc"], bytes(r["ids"])) for r in back) == Counter(want)
    starts = sorted((r["start"], r["n_tokens"], r["doc"] is not None, r["doc"] or 0) for r in back)
    assert [a for a, *_ in starts] == [sum(n for _, n, *_ in starts[:k]) for k in range(len(starts))] and [x[2:] for x in starts] == sorted(x[2:] for x in starts)
    assert {r["kind"] for r in spark.read.parquet(f"{path}/dictionary").collect()} == {"raw"}
    assert {r["doc"] for r in token_files.read_token_files(spark, path, first=5, last=6).collect()} == {5, 6}
    token_files.write_token_files(empty, P.path("byte_bpe_50k.json"), f"{path}0")
    assert token_files.read_token_files(spark, f"{path}0").count() == 0


@pytest.mark.parametrize(("name", "space"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_encoder_is_the_library(name, space, texts):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "É", "ß", "İ", "Σ", "1", "12", "'s", "don't", "...", "\x1c", "\x85", "\xa0", " ", "😀", "é", "\r\n", "中", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "×", "_", "\x00", "word", "."]
    rows = [*texts.values(), None, *("".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    e = Encoder(P.path(name), space)
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(pa.array(rows))] == want


def simhash_of(text):
    words = SPACED.findall(text.translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps, bits):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_op7_components(spark, texts, edge, empty):
    got = query(spark, "op7_simhash")
    fps = {d: simhash_of(t) for d, t in texts.items()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == fps
    assert {d: r["component_id"] for d, r in got.items()} == groups_of(fps, 4)
    found = simhash.near_duplicates(edge).collect()
    assert len(found) == len(EDGE)
    assert {r["component_id"] for r in found if r["doc_id"] in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(empty).count() == 0


def clusters(rng, groups, copies, words):
    """Fingerprints of ``words`` words around random centres, at few and at many bits; equal sizes within a fifth."""
    rows = set()
    for _ in range(groups):
        centre = rng.integers(0, 1 << 63, words, dtype=np.uint64)
        for _ in range(copies):
            x = centre.copy()
            for bit in rng.choice(64 * words, rng.integers(0, 6 * words + 8 * (words > 1)), replace=False).tolist():
                x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.add((tuple(x.tolist()), int(rng.integers(90, 125))))
    return sorted(rows)


@pytest.mark.parametrize(("like", "block", "copies"), [(simhash.Likeness(), 8192, 26), (simhash.Likeness(), 7, 26), (simhash.FOUR_FIFTHS, 8192, 60), (simhash.FOUR_FIFTHS, 40, 26)])
def test_op7_links_lose_nothing(spark, like, block, copies):
    """Clusters of nearby fingerprints, in keys that fit a task and in keys that are cut into blocks."""
    rows = clusters(np.random.default_rng(9), 12, copies, like.words)
    signed = [(i, int(np.uint64(w[0]).view(np.int64)), bytearray(np.array(w[1:], np.uint64).tobytes()), n) for i, (w, n) in enumerate(rows)]
    nodes = spark.createDataFrame(signed, "node long, fp long, more binary, size int")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, like, block)).collect()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for b, (x, n) in enumerate(rows):
        for a, (y, m) in enumerate(rows[:b]):
            bits = [(p ^ q).bit_count() for p, q in zip(x, y, strict=True)]
            if bits[0] <= like.max_bits and sum(bits) <= like.all_bits and min(m, n) >= like.size_ratio * max(m, n):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    assert {i: roots.get(i, i) for i in range(len(rows))} == {i: find(i) for i in range(len(rows))}
    assert 12 <= len({find(i) for i in range(len(rows))}) < len(rows)


def test_op7_pivots_join_a_crowded_cell():
    """Cells beyond PIVOT_CELL: the forest has the components of all links."""
    rng = np.random.default_rng(1)
    like, chain = simhash.FOUR_FIFTHS, simhash._budgets(14)[0]
    rows = clusters(rng, 3, 250, 4)
    words = np.array([w for w, _ in rows], np.uint64)
    size = np.array([n for _, n in rows])
    cell = simhash.Cell(words[:, 0], words[:, 1:], size, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), chain, like)
    i, j = np.triu_indices(len(rows), 1)
    good = cell.near(i, j)

    def labels(pairs):
        label = np.arange(len(rows))
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in np.unique(label)}

    assert len(rows) > simhash.PIVOT_CELL and labels(zip(i[good], j[good], strict=True)) == labels(cell.links())


def later_copies(docs, lengths=None):
    """Lines of later copies of runs of ten words, of every length (or of ``lengths``), but not of the first copies.

    ``docs``: document -> list of (line number, line, words); returns document -> line numbers.
    """
    gone = defaultdict(set)
    for n in lengths or range(1, max(map(len, docs.values()), default=0) + 1):
        first = {}
        for d in sorted(docs):
            for a in range(len(docs[d]) - n + 1):
                run = docs[d][a : a + n]
                if sum(w for *_, w in run) >= 10:
                    source, at = first.setdefault(tuple(x for _, x, _ in run), (d, a))
                    if (source, at) != (d, a):
                        gone[d].update(i for i, *_ in docs[d][max(a, at + n) if source == d else a : a + n])
    return gone


def held_lines(text):
    return [(i, x, len(SPACED.findall(x))) for i, x in enumerate(text.split("\n")) if SPACED.search(x)]


def test_op8_runs(spark, texts, edge, empty):
    got = query(spark, "op8_line_dedup")
    lines = {d: held_lines(t) for d, t in texts.items()}
    gone = later_copies(lines, range(1, 60))
    for d, t in texts.items():
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert (got[d]["lines"], got[d]["deleted"]) == (len(lines[d]), len(gone[d]))
    assert any(gone.values())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(edge).where("text is null or doc_id is null or doc_id < 6").collect() if r["doc_id"] is not None) == sorted((False, i, t) for i, t in EDGE if i is not None and i < 6)
    assert line_dedup.dedup_lines(edge).count() == len(EDGE) and line_dedup.dedup_lines(empty).count() == 0


def test_op8_columns_that_clash(spark):
    rows = [(1, "a b c d e f g h i j", "x", 5, 6, "q"), (2, "a b c d e f g h i j", "y", 5, 6, "q")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string, deleted int, runs int, h string"))
    assert out.columns == ["doc_id", "text", "lines", "deleted", "runs", "h", "lines_", "deleted_", "runs_"]
    assert {tuple(r) for r in out.collect()} == {(1, rows[0][1], "x", 5, 6, "q", 1, 0, 0), (2, "", "y", 5, 6, "q", 1, 1, 1)}


def test_op8_overlap_keeps_a_whole_first_copy(spark):
    rows = [(5, "t u v\n" * 5), (6, "w w w\n" * 4 + "x x x\n" + "w w w\n" * 7), (7, "p q\nr s\n" * 9)]
    out = {r["doc_id"]: r["text"].split("\n")[:-1] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {5: ["t u v"] * 4, 6: ["w w w"] * 4 + ["x x x"], 7: ["p q", "r s", "p q", "r s", "p q"]}


def test_op8_short_lines_go_as_runs(spark):
    run = "\n".join(f"line number {i}" for i in range(6))
    rows = [(1, f"first\n{run}"), (2, f"{run}\nlast"), (3, "line number 0"), (3, "line number 0")]
    out = {(r["doc_id"], r["text"], r["runs"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, f"first\n{run}", 0), (2, "last", 1), (3, "line number 0", 0)}


def passages(docs, n=50):
    """Runs of windows linked with their first occurrence: (document, start, stop, source, start there)."""
    first, links = {}, {}
    for d in sorted(docs, key=lambda d: (d is not None, d)):
        for i in range(len(docs[d]) - n + 1):
            place = first.setdefault(tuple(docs[d][i : i + n]), (d, i))
            if place != (d, i):
                links[d, i] = place
    out = set()
    for (d, i), (e, j) in links.items():
        if links.get((d, i - 1)) != (e, j - 1):
            k = 1
            while links.get((d, i + k)) == (e, j + k):
                k += 1
            out.add((d, i, i + k - 1 + n, e, j))
    return out


def test_op9_passages(spark, texts, edge, empty):
    rows = __spark_entry__.queries()["op9_suffix_dedup"](spark, SF).collect()
    want = passages({d: t.encode().split() for d, t in texts.items()})
    assert Counter(map(tuple, rows)) == Counter(want) and want
    out = {tuple(r) for r in suffix_dedup.repeated_passages(edge.unionByName(edge.where("doc_id = 6").withColumn("doc_id", F.lit(8).cast("long")))).collect()}
    assert out == {(8, 0, 30_000, 6, 0)}
    assert suffix_dedup.repeated_passages(edge).count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_op9_frequent_clauses_hide_nothing(spark, partitions):
    """Pairs that share 60 words, of which 44 (or 30, in the middle) are in 40 others too; overlapping and nested repeats."""
    docs, d = {}, 0
    for g in range(6):
        for clause in (44, 30):
            low = (60 - clause) // 2
            whole = [f"g{g}x{clause}w{i}" for i in range(60)]
            for k in range(42):
                middle = whole if k in (11, 29) else whole[low : low + clause]
                docs[d] = [f"a{d}w{i}" for i in range(k % 9)] + middle + [f"b{d}w{i}" for i in range(30)]
                d += 1
    rng = np.random.default_rng(6)
    pool = [f"p{i}" for i in range(300)]
    for _ in range(40):
        a, b = sorted(rng.integers(0, 300, 2).tolist())
        docs[d] = pool[a:b] + [f"own{d}"] + pool[b : b + 80] * 2
        d += 1
    docs[d] = ["same"] * 400
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 1)
    spark.conf.set("spark.sql.shuffle.partitions", 1 if partitions == 1 else 29)  # chains cross many ranges
    try:
        assert Counter(map(tuple, suffix_dedup.repeated_passages(frame).collect())) == Counter(passages(docs))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_op9_extends_both_ways(spark):
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(1, f"{' '.join(f'a{i}' for i in range(40))} {shared} tail"), (2, f"{' '.join(f'b{i}' for i in range(9))} {shared} {' '.join(f'c{i}' for i in range(30))}"), (3, " ".join(f"s{i}" for i in range(20)))]
    out = {tuple(r) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(2, 9, 79, 1, 40)}


def test_op10_records(spark):
    page = "<html lang=de><head><title>A &amp; B</title></head><body><script>x()</script><p>One<br>two  words</p><a href='/x'>link</a></body></html>"
    rows = [(1, "http://a/", page, 0), (2, None, None, 0), (1, "http://a/", page, 0), (None, "u", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    source = warc.responses(pages)
    out = warc.derivatives(source).collect()
    assert Counter(r["record_type"] for r in out) == {"metadata": 4, "conversion": 4}
    ids = {r["record_id"]: r["payload_digest"] for r in source.collect()}
    for r in out:
        headers = {h["name"]: h["value"] for h in r["headers"]}
        assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Source-Payload-Digest"] == ids[r["refers_to"]]
        assert headers["HTTP-Content-Type"].startswith("text/html")
        assert headers["WARC-Block-Digest"] == warc.digest(bytes(r["block"])) and int(headers["Content-Length"]) == len(r["block"])
        assert warc.parse_record(warc.serialize(list(headers.items()), bytes(r["block"]))[5:]) == (list(headers.items()), bytes(r["block"]))
    texts = {bytes(r["block"]).decode() for r in out if r["key"] == 1}
    assert texts == {"One\ntwo words\nlink", "title: A & B\r\nlanguage: de\r\noutlink: /x\r\n"}
    assert warc.derivatives(source.limit(0)).count() == 0


def test_op10_over_pages(spark):
    """Every page of the table has its two records, linked, with the digests and the text that follow from it."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = __spark_entry__.queries()["op10_warc"](spark, SF).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in rows) == {(p, k): 1 for p in pages for k in ("metadata", "conversion")}
    for r in rows:
        page = pages[r["page_id"]]
        payload = (page["html"] or "").encode()
        source = warc.record_id("response", str(r["page_id"]), " ".join((page["url"] or "").split()), warc.digest(payload))
        headers = dict(x.split(": ", 1) for x in r["headers"].split("\r\n"))
        assert (r["refers_to"], headers["WARC-Source-Payload-Digest"]) == (source, warc.digest(payload))
        assert r["block_digest"] == warc.digest(r["content"].encode()) and r["content_length"] == len(r["content"].encode())
        if r["record_type"] == "conversion":
            assert "<script" not in r["content"] and "\n\n" not in r["content"]


def test_op10_encodings_and_types(spark):
    """Charsets, content and transfer encodings are undone; an image has no conversion; null and empty blocks are empty pages."""
    import gzip

    page = "<p>Größe</p>"
    packed = gzip.compress(page.encode())
    chunks = b"%x\r\n" % 5 + packed[:5] + b"\r\n" + b"%x\r\n" % (len(packed) - 5) + packed[5:] + b"\r\n0\r\n\r\n"
    cases = {
        "latin": (b"Content-Type: text/html; charset=ISO-8859-1", page.encode("latin-1"), "Größe"),
        "meta": (b"Content-Type: text/html", b"<meta charset=latin1>" + page.encode("latin-1"), "Größe"),
        "chunked": (b"Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks, "Größe"),
        "plain": (b"Content-Type: text/plain", b"a <b>\n\nc", "a <b>\n\nc"),
        "broken": (b"Content-Type: text/html\r\nContent-Encoding: gzip", b"no gzip", ""),
        "image": (b"Content-Type: image/png", b"\x89PNG", None),
        "idna": (b"Content-Type: text/html; charset=idna", page.encode(), "Größe"),
        "undefined": (b"Content-Type: text/html; charset=undefined", page.encode(), "Größe"),
        "hex": (b"Content-Type: text/html; charset=hex", page.encode(), "Größe"),
        "twice": (b"Content-Type: text/html\r\nContent-Encoding: gzip, gzip", gzip.compress(packed), "Größe"),
        "members": (b"Content-Type: text/html\r\nContent-Encoding: gzip", packed + gzip.compress(b"<p>more"), "Größe\nmore"),
        "brotli": (b"Content-Type: text/html\r\nContent-Encoding: br", b"\x0b\x02\x80", None),
        "both": (b"Content-Type: text/html\r\nContent-Encoding: gzip, br", b"\x0b\x02\x80", None),
        "chunk": (b"Content-Type: text/html\r\nTransfer-Encoding: chunked", b"3\r\n<p>\r\nzz\r\nrest", "zz\nrest"),
    }
    flagged = {"broken": "malformed gzip", "idna": "unknown idna", "undefined": "unknown undefined", "hex": "unknown hex", "brotli": "unknown br", "both": "unknown br", "chunk": "malformed chunked"}
    rows = [(k, "response", f"<urn:{k}>", "u", None, [], bytearray(b"HTTP/1.1 200 OK\r\n" + h + b"\r\n\r\n" + p), 1) for k, (h, p, _) in cases.items()]
    rows += [("null", "response", None, None, None, None, None, 1), ("other", "request", "x", "u", None, [], bytearray(b"GET"), 1), ("long", "response", "<urn:l>", "u", None, [], bytearray(b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>word </p>" * 200_000), 1)]
    records = spark.createDataFrame(rows, "key string, record_type string, record_id string, target_uri string, payload_digest string, headers array<struct<name:string,value:string>>, block binary, extra int")
    out = {(r["key"], r["record_type"]): bytes(r["block"]).decode() for r in warc.derivatives(records).collect()}
    assert {k for k, t in out if t == "metadata"} == {*cases, "null", "long"}
    assert {k: v for (k, t), v in out.items() if t == "conversion" and k != "long"} == {k: t for k, (_, _, t) in cases.items() if t is not None} | {"null": ""}
    assert out["long", "conversion"].split() == ["word"] * 200_000
    assert {k: v.strip() for (k, t), v in out.items() if t == "metadata" and "undecoded" in v} == {k: f"undecoded: {v}" for k, v in flagged.items()}


def test_op10_pages_that_close_nothing():
    text = {
        "<html><head><title>T</title><body><p>hello world</p></body>": "hello world",
        "<head><meta charset=utf-8><title>T</title><p>one<nav>two<p>three": "one two\nthree",
        "a<svg>b<iframe src=x>c": "a b c",
        "a<nav>x</nav>b<NAV>y</nav >c<svg>d": "a b c d",
        "a<nav><nav>x</nav>y</nav>b": "a y b",
        "a<script>x<p>y": "a",
        "a<!-- b": "a",
        "<title>never closed <p>b": "",
        "": "",
    }
    for page, want in text.items():
        assert " ".join(warc.plain_text(page).replace("\n", " \n ").split(" ")).replace(" \n ", "\n") == want or warc.plain_text(page).split() == want.split(), page
    many = "<nav>a " * 100_000
    assert warc.plain_text(many).split() == ["a"] * 100_000


class Extractor(html.parser.HTMLParser):
    """Words that the standard library's parser shows, outside of elements that are not shown."""

    GONE = {"script", "style", "title", "template", "noscript", "svg", "iframe", "nav"}

    def __init__(self):
        super().__init__()
        self.depth, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.GONE:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if self.depth and tag == self.depth[-1]:
            self.depth.pop()

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def test_op10_text_by_another_parser(spark):
    """The text of every page has the letters that the standard library's parser finds, in order."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in __spark_entry__.queries()["op10_warc"](spark, SF).where("record_type = 'conversion'").collect():
        parser = Extractor()
        parser.feed(pages[r["page_id"]])
        parser.close()
        assert "".join(r["content"].split()) == "".join("".join(parser.out).split()), r["page_id"]


def test_op4_never_above_best_fit_and_clashing_columns(spark):
    """No block takes more bins than best fit of the largest first; columns may be called like those of the packing."""
    rng = np.random.default_rng(12)
    for n in (30, 300):
        sizes = rng.integers(1, 700, n)
        bins: list = []
        packing.best_fit(sizes, list(range(n)), bins, [], 1000)
        assert len(packing.evolve(sizes, [], 3, 4, 1000)) <= len(bins)
    names = ["bin", "block", "bins", "island", "filled", "round", "source", "sequence_id", "offset"]
    rows = [(int(x), *([i] * len(names))) for i, x in enumerate(rng.integers(1, 100, 200))]
    out = packing.pack(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ["length", *names])), 100)
    assert out.columns == ["length", *names, "sequence_id_", "offset_"]
    got = out.collect()
    assert sorted(tuple(r[:10]) for r in got) == sorted(rows)
    filled = Counter()
    for r in got:
        filled[r["sequence_id_"]] += r["length"]
    assert max(filled.values()) <= 100 and all(r["offset_"] < filled[r["sequence_id_"]] for r in got)


def test_op10_reads_files(spark, tmp_path):
    import gzip

    one = warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Length", "7")], b"a\r\n\r\n\xff\n")
    (tmp_path / "x.warc").write_bytes(one * 2)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    (tmp_path / "z.warc").write_bytes(b"")
    found = warc.read_records(spark, f"file://{tmp_path}/*").collect()
    assert len(found) == 4 and {(r["record_type"], r["record_id"], bytes(r["block"])) for r in found} == {("response", "<urn:uuid:1>", b"a\r\n\r\n\xff\n")}
    # what is written is read back
    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (2, "http://b/", "")], "page_id long, url string, html string")
    records = warc.responses(pages)
    data = b"".join(bytes(r[0]) for r in records.select(warc.warc_bytes(records)).collect())
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "w.warc").write_bytes(data)
    back = warc.read_records(spark, f"file://{tmp_path}/all")
    assert {(r["record_id"], bytes(r["block"])) for r in back.collect()} == {(r["record_id"], bytes(r["block"])) for r in records.collect()}
    (tmp_path / "all" / "bad.warc").write_bytes(one[:-9])
    with pytest.raises(Exception, match="a WARC record of"):
        warc.read_records(spark, f"file://{tmp_path}/all").collect()


def jaccard_classes(texts, shingle=5):
    """Least id of the class of every text, linked at a Jaccard similarity of 0.8 of the shingles."""
    sets = {d: set(simhash.shingles(t.encode(), shingle).tolist()) for d, t in texts.items()}
    root = {}
    for d in sorted(sets):
        near = {root[e] for e in root if 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])} | {d}
        root[d] = min(near)
        root = {e: min(near) if r in near else r for e, r in root.items()}
    return root


def test_pipeline_stages(spark, edge, empty):
    """Every stage against brute force on the rows that it was given."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(C.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]

    def run(name, docs):
        out = spark.createDataFrame(stages[name](spark, docs, SF).collect(), docs.schema)
        assert out.columns == columns
        return out, {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["text"] or "" for r in out.collect()}

    kept = {r["doc_id"] for r in query(spark, "op5_quality_rules").values() if r["kept"]}
    docs, before, after = run("quality rules", docs)
    assert after == {d: t for d, t in before.items() if d in kept} and 0 < len(after) < len(before)
    docs, before, after = run("line dedup", docs)
    gone = later_copies({d: held_lines(t) for d, t in before.items()}, range(1, 60))
    assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
    assert {r["doc_id"]: r["n_chars"] for r in docs.collect() if gone[r["doc_id"]]} == {d: len(after[d]) for d in after if gone[d]}
    docs, before, after = run("SimHash near-dedup", docs)
    root = jaccard_classes(before)
    # no document goes that is not in one class with one that stays; of those that should go, nine in ten do at least
    assert all(after[d] == before[d] for d in after) and all(d in after for d in before if root[d] == d)
    doubles = sum(root[d] != d for d in before)
    assert 0.9 * doubles <= len(before) - len(after) <= doubles and doubles
    docs, before, after = run("benchmark decontamination", docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == {d: before[d] for d, (_, hit, _, _) in contamination(before, items).items() if not hit} and len(after) < len(before)
    rows = stages["best-fit packing"](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert Counter(r["doc_id"] for r in rows) == {d: -(-(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) // 2048) for d, t in after.items()}


def test_pipeline_edge_rows(spark, edge, empty):
    """Nulls, empty and long texts, ties, repeated rows, columns that clash, no rows."""
    import corpus_pipeline as C

    stages = dict(C.STAGES)
    odd = edge.withColumn("id2", F.lit(1)).withColumn("tie2", F.lit("t")).withColumn("key", F.lit("k")).withColumn("c0", F.lit(2)).withColumn("lines", F.lit("l")).withColumn("deleted", F.lit(5)).withColumn("text_", F.lit(0))
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    every = Counter(i for i, _ in EDGE)
    assert ids(stages["quality rules"](spark, odd, SF)) == {6: 1}
    assert ids(stages["line dedup"](spark, odd, SF)) == every
    # 'a b c' of 1 (twice) and 5; the texts without words: null id with a null text, 2, 3, 4
    assert ids(stages["SimHash near-dedup"](spark, odd, SF)) == {1: 2, None: 2, 6: 1, 7: 1}
    assert ids(stages["benchmark decontamination"](spark, odd, SF)) == every
    assert ids(stages["best-fit packing"](spark, odd, SF).where("piece = 0")) == every
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert C.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_components_of_chains_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def edited(rng, base, edits):
    words = list(base)
    for at in rng.integers(0, len(words), edits).tolist():
        words[at] = f"new{at}x{rng.integers(1000)}"
    return words


def test_near_copies_at_four_fifths(spark, edge, empty):
    """Copies with edited words: those with a Jaccard similarity of 0.8 of five-word shingles are linked, near misses never."""
    rng, rows = np.random.default_rng(4), []
    for group in range(80):
        base = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))]
        rows.append((10 * group, " ".join(base)))
        rows.append((10 * group + 1, " ".join(edited(rng, base, int(rng.integers(1, 2 + len(base) // 25))))))
    root = jaccard_classes(dict(rows))
    alike = {g for g in range(80) if root[10 * g + 1] == 10 * g}
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), like=simhash.FOUR_FIFTHS, shingle=5).collect()
    groups = {r["doc_id"]: r["component_id"] for r in found}
    linked = {g for g in range(80) if groups[10 * g + 1] == 10 * g}
    assert len(groups) == len(rows) and all(c // 10 == d // 10 for d, c in groups.items())
    assert 20 < len(alike) < 70 and linked <= alike and len(linked) >= 0.9 * len(alike)
    assert simhash.near_duplicates(edge, like=simhash.FOUR_FIFTHS, shingle=5).count() == len(EDGE)
    assert simhash.near_duplicates(empty, like=simhash.FOUR_FIFTHS, shingle=5).count() == 0


def test_near_copies_in_a_crowd(spark):
    """Hundreds of copies of one text with few edits, and a chain whose ends are not alike; cells are cut into blocks."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(1, 5))))) for i in range(700)]
    chain = [f"c{i}" for i in range(400)]
    for k in range(8):
        rows.append((1000 + k, " ".join(chain)))
        chain = edited(rng, chain, 8)
    root = jaccard_classes({d: t for d, t in rows if d >= 1000})
    for block in (simhash.BLOCK, 100):
        found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), like=simhash.FOUR_FIFTHS, shingle=5, block=block).collect()
        groups = {r["doc_id"]: r["component_id"] for r in found}
        assert {d: groups[d] for d in root} == root
        # pairs of this crowd have a similarity of 0.77 to 0.97: all are linked by way of others
        assert {groups[d] for d in range(700)} == {0}


def test_op8_runs_of_every_length(spark):
    """Lines of one to twelve words, in repeated runs of every length, against brute force over all lengths."""
    three = "one two three four five six\nseven\na b c d e f g"
    seven = "\n".join(f"first{i} second{i}" for i in range(7))
    rows = [(1, f"start\n{three}\nend"), (2, f"begin\n{three}\nstop"), (100, f"u\n{seven}\nv"), (101, f"w\n{seven}\n\nx"), (102, f"{seven}\n{seven}\n{three}")]
    rng = np.random.default_rng(8)
    pool = [" ".join(f"v{k}x{i}" for i in range(int(rng.integers(1, 13 if k % 5 == 0 else 4)))) for k in range(40)]
    for d in range(3, 60):
        parts = []
        for _ in range(4):
            a = int(rng.integers(0, 40))
            parts += [f"own {d} {rng.integers(1000)}", *pool[a : a + int(rng.integers(1, 20))]]
        rows.append((d, "\n".join(parts)))
    # few distinct lines: overlapping and periodic runs
    rows += [(d, "\n".join(rng.choice(["a b", "c d e", "f"], int(rng.integers(1, 40))).tolist())) for d in range(60, 75)]
    lines = {d: held_lines(t) for d, t in rows}
    gone = later_copies(lines)
    assert gone[2] == {1, 2, 3} and gone[101] == set(range(1, 8))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_op8_order_is_a_suffix_array(spark):
    """The order puts suffixes of islands in the order of their lines' ranks, and neighbours share ``lcp`` lines."""
    rng = np.random.default_rng(2)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", f"own {d}"], 50, p=[0.5, 0.3, 0.19, 0.01]).tolist())) for d in range(12)]
    held = spark.createDataFrame(rows, "doc_id long, text string").select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")).alias("d"), F.posexplode(line_dedup._held(F.col("text"))).alias("at", "x")).select("d", "at", "x.*")
    order = line_dedup.suffix_array(line_dedup.suffix_paths(line_dedup._islands(held, 10)), 1000).orderBy("seq").collect()
    split, count = {d: t.split("\n") for d, t in rows}, Counter(x for _, t in rows for x in t.split("\n"))

    def island(d, at):
        out = []
        for x in split[d][at:]:
            if count[x] == 1:
                break
            out.append(x)
        return out

    found = [island(r["d"]["id"], r["at"]) for r in order]
    rank = {x: i for i, x in enumerate(dict.fromkeys(f[0] for f in found))}
    keys = [[rank[x] for x in f] for f in found]
    assert keys == sorted(keys) and len(keys) == sum(n for n in count.values() if n > 1)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in order] == [0, *(shared(a, b) for a, b in zip(keys, keys[1:], strict=False))]
