"""Text operators against brute force, and their edge cases: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tarnlake.llm")
from tokenizers import Tokenizer  # noqa: E402

from tarnlake.llm import bpe, components, embed_dedup, jaccard, kneser_ney, langid, packing, quality, secret_scan, textkern, token_files, warc  # noqa: E402
from tarnlake.llm.common import Stash  # noqa: E402
from tarnlake.llm.queries import TOKENIZER  # noqa: E402

WORDS = "alpha beta gamma delta the of and house river token stone light über façade niño 日本 x1 don't".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, g int"
LONG = " ".join(WORDS[k * k % len(WORDS)] + str(k % 97) for k in range(6000)) + "a" * 5000


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \n\t", "one", "two words here", LONG, "x<|endoftext|>y 's don't", "　wide space", "😀🎉 émoji"]
    for k in range(40):
        base = [WORDS[i] for i in rng.integers(0, len(WORDS), 60)]
        out.append(" ".join(base))
        if k % 4 == 0:
            out.append(" ".join(base))  # a copy
            out.append(" ".join([*base[:30], "CHANGED", *base[31:]]))  # a near copy
            out.append(" ".join(base).upper())
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(k, x, ("en", "de", None)[k % 3], "s0" if k % 2 else None, len(x or ""), "clash", "clash", 1) for k, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def table(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference(table):
    t = Tokenizer.from_file(TOKENIZER)
    return {k: t.encode(x, add_special_tokens=False).ids for k, x in table.items()}


def test_bpe(docs, table, reference):
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, TOKENIZER).collect()}
    for k, ids in reference.items():
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(table[k].encode()).hexdigest()
    coded = bpe.bpe_encode(docs, TOKENIZER)
    assert {r["doc_id"]: r["text"] for r in bpe.bpe_decode(coded, TOKENIZER).collect()} == table


@pytest.mark.parametrize("kind", [bpe.Vocabulary, bpe.LibraryVocabulary])
def test_bpe_fuzz(kind):
    v, t = kind.load(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(0)
    parts = ["a", "b", "é", "ß", "1", "²", " ", "  ", "\n", "\t", "　", "'", "'s", "'re", "'ll", "-", "!!", "<|endoftext|>", "日本", "😀", "\r\n", "\x1c", "ab" * 40]
    made = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(1500)]
    ids, first = bpe.encode_chunk(v, *textkern.column_bytes(pa.array(made)))
    for k, r in enumerate(t.encode_batch(made, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == r.ids, made[k]


def thue_morse(n, a="a", b="b"):
    """Two strings of n letters in an arrangement and its complement, which polynomial hashes modulo a power of two confuse."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


ARRANGED = [1 << k for k in range(3, 17)]


def test_arranged_words(spark):
    """Arrangements and their complements as words, lines and whole texts, in all operators that know words by hashes."""
    made = [t for n in ARRANGED for t in thue_morse(n)]
    lines = [f"{x} z z z\n{y} z z z" for x, y in (thue_morse(n) for n in ARRANGED[:10])]
    wordy = [x.replace("a", "left ").replace("b", "right ") for n in ARRANGED[:8] for x in thue_morse(n)]
    texts = made + lines + wordy
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    t = Tokenizer.from_file(TOKENIZER)
    ids = {k: t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(df, TOKENIZER).collect()}
    files = {r["doc_id"]: r for r in token_files.token_file_round_trip(df, TOKENIZER).collect()}
    stats = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    packed = defaultdict(list)
    for r in packing.pack_documents(df, TOKENIZER).collect():
        packed[r["doc_id"]].append(r)
    for k, x in enumerate(texts):
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest() and got[k]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
        assert files[k]["ids_crc32"] == zlib.crc32(np.array([*ids[k], 2], "<u4"))
        for r in packed[k]:
            assert r["ids_crc32"] == zlib.crc32(np.array([*ids[k], 0][r["start"] : r["start"] + r["length"]], "<u4"))
        assert tuple(stats[k][c] for c in quality.COUNTS) == brute_stats(x), k
    sets = {k: shingles(x) for k, x in enumerate(texts)}
    expected = brute_components(sets, jaccard_linked)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == expected
    scored = {r["doc_id"]: r for r in kneser_ney.score_documents(df, F.col("doc_id") % 2 == 1).collect()}
    known = {w for k in ids if k % 2 == 0 for w in texts[k].split()}
    assert {k: r["n_known"] for k, r in scored.items()} == {k: 1 + sum(w in known for w in x.split()) for k, x in enumerate(texts)}


def test_equal_hashes(monkeypatch):
    """With one hash for all words, bytes still tell them apart."""
    monkeypatch.setattr(textkern, "block_hash", lambda blocks, first, length: np.zeros(len(length), np.uint64))
    v, t = bpe.Vocabulary.load(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    made = ["the house and the river the stone", "stone by the river", "", "house" * 9 + " " + "stone" * 9 + " " + "house" * 9]
    buf, off = textkern.column_bytes(pa.array(made))
    s, e, _ = textkern.words(buf, off)
    one, which = textkern.distinct(buf, s, e)
    spans = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert [spans[one[k]] for k in which] == spans and len(one) == len(set(spans))
    store = bpe.WordStore()
    for _ in range(2):
        ids, at, n = store.encode(v, buf, s, e)
        assert [ids[a : a + c].tolist() for a, c in zip(at, n, strict=True)] == [t.encode(x.decode(), add_special_tokens=False).ids for x in spans]


def test_short_specials():
    """Special tokens of any length are looked up, however many words of their length there are."""
    v = bpe.Vocabulary.load(TOKENIZER)
    v.specials = {b"<s>": 7, b"<|endoftext|>": 50256}
    buf, off = textkern.column_bytes(pa.array(["a<s>b <s>", "<|endoftext|> abc <s"]))
    ids, first = bpe.encode_chunk(v, buf, off)
    assert ids[: first[1]].tolist().count(7) == 2 and ids[first[1]] == 50256 and 7 not in ids[first[1] :]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(docs, reference, kind):
    got = {r["doc_id"]: r for r in token_files.token_file_round_trip(docs, TOKENIZER, 2, kind=kind).collect()}
    start = 0
    for k in sorted(reference):
        ids = [*reference[k], 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_planes():
    x = np.random.default_rng(0).integers(0, 2**32, 1000).astype(np.uint32)
    for kind in ("byte", "bit"):
        assert (token_files.from_planes([p.tobytes() for p in token_files.to_planes(x, kind)], len(x), kind) == x).all()


def test_packing(docs, reference):
    by, seq = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, TOKENIZER, 64).collect():
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for k, ids in reference.items():
        own, at = [*ids, 0], 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            piece = own[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(own)
    padding = 0
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding < 0.02 * sum(len(i) + 1 for i in reference.values())


def test_best_fill_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 40, 9).tolist()
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        used = packing.best_fill(Counter(lengths), 60)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 60) and all(n <= lengths.count(k) for k, n in used.items())


def test_windows_are_closed():
    """No window but the last stays short, items stay whole but for one cut a window, and nothing becomes crumbs."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 700, 1024).tolist(), [600] * 500, rng.integers(1, 1024, 700).tolist(), [1023] * 50, [1] * 3000, [513] * 7, []):
        groups = packing.pack_lengths(lengths, 1024, 8)
        assert all(1016 <= sum(p.length for p in g) <= 1024 for g in groups[:-1]) and len(groups) <= sum(lengths) // 1016 + 1
        cover = defaultdict(list)
        for g in groups:
            for p in g:
                cover[p.item].append((p.begin, p.length))
        for i, n in enumerate(lengths):
            at = 0
            for begin, length in sorted(cover[i]):
                assert begin == at and length > 0
                at += length
            assert at == n
        assert sum(len(c) for c in cover.values()) <= len(lengths) + len(groups)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(sets, linked):
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def jaccard_linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def test_jaccard(docs, table):
    sets = {k: shingles(t) for k, t in table.items()}
    expected = brute_components(sets, jaccard_linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: (len(sets[k]), expected[k]) for k in table}


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Groups beyond one task: near copies of near copies, and two kinds that share rare passages without linking."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    other = base[:40] + [f"v{i}" for i in range(20)]
    made = []
    for k in range(60):
        t = list(base if k % 2 else other)
        for i in rng.integers(0, len(t), rng.integers(0, 3)):
            t[i] = f"z{k}x{i}"
        made.append(" ".join(t))
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 8)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = {k: shingles(t) for k, t in enumerate(made)}
    expected = brute_components(sets, jaccard_linked)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == expected


def test_t_occurrence_finds_all():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**47, 300).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = rng.choice(pool, rng.integers(2, 40), replace=False)
        sets += [np.sort(own), np.sort(own[: max(1, int(len(own) * 0.8))])]
    expected = brute_components({k: frozenset(s.tolist()) for k, s in enumerate(sets)}, jaccard_linked)
    links = jaccard.t_occurrence_links(sets)
    label = components.min_labels(len(sets), np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    assert {k: int(x) for k, x in enumerate(label)} == expected


def test_merge_skip():
    rng = np.random.default_rng(0)
    for least in (1, 2, 4):
        lists = [sorted(set(rng.integers(0, 30, 12).tolist())) for _ in range(9)]
        n = Counter(x for s in lists for x in s if x >= 7)
        from bisect import bisect_left

        assert jaccard.merge_skip(lists, [bisect_left(s, 7) for s in lists], least) == {x: c for x, c in n.items() if c >= least}


def test_components(spark):
    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(e, "u long, v long"), Stash(spark, "t")).collect()}
    expected = brute_components({k: {p for p in e if k in p} for k in {x for p in e for x in p}}, lambda a, b: bool(a & b))
    label = components.min_labels(400, np.array([x for x, _ in e]), np.array([y for _, y in e]))
    assert {k: int(label[k]) for k in expected} == expected
    assert got == {k: x for k, x in expected.items() if any(k in p and p[0] != p[1] for p in e)}


@pytest.mark.parametrize("cell", [1024, 8])
def test_embeddings(spark, monkeypatch, cell):
    """In one cell, and in many cells of many blocks."""
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    if cell < 1024:
        monkeypatch.setattr(embed_dedup, "LEAST_BLOCK", 4)
        monkeypatch.setattr(embed_dedup, "BLOCK", 4)
        monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 4 * 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 8))
    for k in range(40, 80):
        x[k] = x[0] + 0.12 * rng.normal(size=8)
    for k in range(80, 95):
        x[k] = x[1] + 0.3 * rng.normal(size=8)
    x[100] = x[99]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [], 0), (204, [1.0, None], 0), (205, [1.0, 2.0], 0)]
    # Squares of these overflow or vanish; equal directions link all the same. Columns of other names have no part in it.
    rows += [(300, [1e200, 1e200, 0.0], 0), (301, [1e200, 1e200, 0.0], 0), (302, [3e-170, 3e-170, 1e-180], 0), (303, [1.0, 1.0, 0.0], 0), (304, [1.0, -1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("key", "rep", "vec", "cell", "n", "a", "b")}).repartition(4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    label = components.min_labels(len(x), *np.nonzero(hit))
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    for k in range(120):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (hit[k].sum(), label[k], label[k] == k), k
    for k in (*range(200, 206), 304):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(300, 304)] == [(3, 300)] * 4


def test_guests_bound(spark):
    """Vectors that link across cells are always guests; clustered vectors are guests of few cells."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.3 * rng.normal(size=(40, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    p, reach = x[::40], math.sqrt(0.2)
    home = (x @ p.T).argmax(1)
    for j in range(1, 12):
        own = x[home == j]
        guest = embed_dedup._margins(own, p, j) <= reach + 1e-9
        for i in range(j):
            linked = (own @ x[home == i].T >= 0.9).any(1)
            assert not (linked & ~guest[:, i]).any()
    df = spark.createDataFrame([(k, 1, v.tobytes()) for k, v in enumerate(x)], "rep long, copies long, vec binary")
    _, blocks, _, _ = embed_dedup.vector_blocks(df, Stash(spark, "t"), 0.9)
    assert 1 <= embed_dedup.replication(blocks) <= 3


def test_language(spark):
    rng = np.random.default_rng(0)
    vocab = {"en": "the house and river of light with stone this that".split(), "de": "das haus und der fluss mit stein dieser über straße".split(), "ru": "дом и река свет камень этот".split()}
    rows = []
    for k in range(240):
        lang = ("en", "de", "ru")[k % 3]
        rows.append((k, " ".join(rng.choice(vocab[lang], 30)), lang))
    rows += [(900, None, "en"), (901, "123 !!", None), (902, "", "de"), (903, " ".join(vocab["en"] * 3 + vocab["ru"] * 3), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in langid.identify_languages(df, spans=True).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] for k in held) and np.mean([got[k]["lang_pred"] == ("en", "de", "ru")[k % 3] for k in held]) > 0.95
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [s["lang"] for s in got[903]["spans"]] == ["en", "ru"]
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify_languages(none).first()["lang_pred"] == "und"


def test_viterbi_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(size=(6, 3)) * 3
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert langid.viterbi(s, np.array([0, 6]), 2.0).tolist() == list(best)


def test_secrets(spark):
    made = ['password = "abcdefghijkl1"', "API_KEY:AKIA" + "A1" * 8 + " token=token=abcdefghijklmn", "AKIA123 0123456789abcdef0", "ſecret=aaaaaaaaaaaaa", 'k = "aB3$xY9!qwPz7"\npassword = k', "é" * 5 + " passwd: zzzzzzzzzzzz0000", None, "", "plain text: nothing", "deadbeef" * 4000]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for k, t in enumerate(made):
        t = t or ""
        spans = sorted([(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])
        shown = ",".join(f"{secret_scan.KINDS[x]}:{a}:{b}" for a, x, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), t[:40]
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == tuple(sum(s[1] == j for s in spans) for j in range(3))
    assert "named:5:18" in got[4]["spans"]
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(df).collect()}
    assert masked[0] == "[secret]\"" and masked[6] is None and masked[8] == made[8] and "aB3" not in masked[4]


def test_named_secrets():
    """Triple quotes, aligned assignments, literals joined over lines, and base64 that begins with a slash; paths and diffs are left."""
    key, half = "ghp_A1b2C3d4E5f6G7h8J9", "A1b2C3d4E5"
    shown = lambda t: [t[s.start : s.end] for s in secret_scan.named_spans(t)]
    for quote in ('"""', "'''"):
        assert shown(f"token = {quote}{key}{quote}\nx = 1") == shown(f"token = {quote}\n  {key}\n{quote}") == [key]
    assert shown(f"password{' ' * 60}={' ' * 60}'{key}'") == [key]
    for gap in ("\n    + ", " +\n    ", " + \\\r\n  ", "\n  . ", " " * 20 + "+" + " " * 20):
        (found,) = shown(f'secret = "{half}"{gap}"f6G7h8J9k0"')
        assert found.startswith(half) and found.endswith("f6G7h8J9k0")
    assert shown('aws_secret_access_key = "/Abc9dEf0GhI1jKl2MnO3pQr4StU5vWx6YzA7bC8"') == ["/Abc9dEf0GhI1jKl2MnO3pQr4StU5vWx6YzA7bC8"]
    assert shown('secret = "/etc/ssl/Private2024/serverKey.pem"\ntoken: /var/run/secrets/kubernetes.io/token1') == []
    assert shown(f'+host = "plainhost-0A1b2C3d"\n+password = "{key}"\n+host = "b"') == [key]
    assert shown('token = """unclosed\n' * 3) == []
    assert shown(f'text = """\npassword = "{key}"\n"""') == [key]


def test_named_secrets_by_construction():
    """Statements whose pairs are known when they are made, in any order; sensitivity by the closure of all assignments."""
    rng = np.random.default_rng(11)
    for _ in range(150):
        text, pairs, flows = "", [], set()  # (name, start, end, value); (target, source)
        names = [f"c{i}" for i in range(6)] + ["db.password", "apiKey", "user_token", "session"]
        for _ in range(rng.integers(2, 14)):
            name, other = rng.choice(names), rng.choice(names[:6])
            value = "".join(rng.choice(list("aB3$xY9!qwPz7KmN"), rng.integers(6, 20)))
            kind = rng.integers(0, 11)
            quote = rng.choice(['"', "'"])
            if kind == 0:
                text += f"  {name}   =   {other};\n"
                flows.add((name, other))
                continue
            if kind == 1:
                text += "it's plain: prose, with (brackets) and 'quotes' -> nothing == nothing\n"
                continue
            head, tail = {
                2: (f"{name} = {quote}", quote), 3: (f'"{name}": {quote}', quote + ","), 4: (f"export {name}:={quote}", quote), 5: (f"{name} => {quote}", quote), 6: (f'{name} = """\n  ', '\n"""'), 7: (f"{name}: |\n    ", "\nnext"),
                8: (f"{name}({quote}", quote + ")"), 9: (f'put("{name}", {quote}', quote + ")"), 10: (f"{name} = (\n  {quote}", quote + ")"),
            }[int(kind)]
            joined = kind in (2, 3, 10) and rng.random() < 0.4
            body = value[:3] + quote + rng.choice([" + ", "\n   ", " . "]) + quote + value[3:] if joined else value
            text += head
            pairs.append((name, len(text), len(text) + len(body), value, kind in (8, 9)))
            text += body + tail + "\n"
        reach = {(n, n) for n in names} | flows | {(t.rsplit(".", 1)[-1], s) for t, s in flows}
        for _ in names:
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
        expected = {}
        for name, a, b, value, call in pairs:
            w = max(secret_scan.name_weight(t) for t, s in reach if s in (name, name.rsplit(".", 1)[-1]))
            if call and not secret_scan.name_weight(name):
                continue
            expected[a, b] = secret_scan.literal_weight(value) and w and w + secret_scan.literal_weight(value) >= 4
        assert [(s.start, s.end) for s in secret_scan.named_spans(text)] == sorted(k for k, v in expected.items() if v), text


def test_constants_in_both_directions():
    value = "aB3$xY9!qwPz7"
    for t in (f'k = "{value}"\npassword = k', f'password = k\nk = "{value}"', f'password = j\nj = self.k\nself.k = "{value}"'):
        (s,) = secret_scan.named_spans(t)
        assert t[s.start : s.end] == value
    assert not secret_scan.named_spans(f'k = "{value}"\nplace = k\npassword = place2')
    key = "MIIEpQIBAAKCAQEA3Tz2mr7SZiAMfQyuvBjM9Oi\nNd3rKCVp1n2Q9A8fPQe4oY1XLmK0y"
    for t in (f'private_key = """-----BEGIN KEY-----\n{key}\n-----END KEY-----"""', "private_key: |\n  " + key.replace("\n", "\n  ") + "\nother: 1"):
        (s,) = secret_scan.named_spans(t)
        assert "MIIEpQ" in t[s.start : s.end] and "XLmK0y" in t[s.start : s.end] and "other" not in t[s.start : s.end]


@pytest.mark.parametrize("text", ["note\n" + "a" * 5_000_000 + "\nk: v = 1", "a.b" * 1_700_000 + "= 1", " " * 2_500_000 + "=" + " " * 2_500_000 + ":", "a=" * 2_500_000, "a: |\n " * 300_000, 'x="""' + '\\"""' * 1_000_000, "(\n" * 2_000_000 + '"'])
def test_lexer_is_linear(text):
    import time

    start = time.process_time()
    assert secret_scan.named_spans(text) == []
    assert time.process_time() - start < 8  # a quadratic lexer takes hours


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, at = set(), 0, defaultdict(list)
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        t = " ".join(rng.choice(WORDS, rng.integers(25, 60))) + "."
        rows.append((k, t, "en", "s0"))
    rows += [(1000, "\n".join(["same line here again"] * 20), "en", "s0"), (1001, " ".join(w + "###$$$" for w in rng.choice(WORDS, 40)), "en", "s0"), (1002, None, None, None), (1003, "", "en", None), (1004, "a a a a a a a a a a a a", "en", "s0"), (1005, LONG, "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    for k, t, *_ in rows:
        b = brute_stats(t or "")
        assert tuple(got[k][c] for c in quality.COUNTS) == b, k
        assert got[k]["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
    assert all(got[k]["kept"] for k in range(300)) and not got[1001]["kept"] and not got[1002]["kept"] and not got[1003]["kept"]


@pytest.mark.parametrize("many", [40, 400])
def test_quality_of_few_rows(spark, many):
    """Pools below the least number of rows: a whole small table, and a rare language and null labels in a larger one."""
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(rng.choice(WORDS, n))
    junk = lambda: " ".join(w + "###$$$" for w in rng.choice(WORDS, 40))
    rows = [(k, words(rng.integers(25, 60)), "en", "s0") for k in range(many)]
    rows += [(1000, words(40), "rare", "s1"), (1001, junk(), "rare", "s1"), (1002, words(40), None, None), (1003, junk(), None, None), (1004, junk(), "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    good = {k for k, *_ in rows} - {1001, 1003, 1004}
    assert {r["doc_id"] for r in quality.quality_verdicts(df).where("kept").collect()} == good
    assert {r["doc_id"] for r in quality.keep_quality(df).collect()} == good


def test_least_determinant(spark, tmp_path):
    """Against all subsets of a small group: the determinant is the least, but for the width of a bin of distances, and so are the verdicts."""
    import itertools

    rng = np.random.default_rng(8)
    n, h = 26, 20
    rows = []
    for k in range(n):
        far = k in (3, 11, 17, 20)
        words = rng.choice(WORDS, rng.integers(25, 60)).tolist()
        marks = rng.integers(8, 12) if far else rng.integers(0, 3)
        long = 6 if far else 0
        lines = "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
        rows.append((k, lines + " " + "# " * int(marks) + " " + " ".join("x" * 30 + str(i) for i in range(long)), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stash = Stash(spark, "t")
    counted = quality._counted(df, stash, "bigint", "text", "doc_id", "lang", "source")
    x = np.array([[r[c] for c in quality.FEATURES] for r in counted.where("not base_failed").orderBy("key").collect()])
    assert len(x) == n
    found = quality.estimates(counted, stash, h / n, 1e-9, 3).first()
    raw = spark.read.parquet(f"{stash.path}/step2").where("g like 'p:%'").first()
    det = lambda rows: np.linalg.det(quality.eased(np.cov(rows.T, bias=True)))
    # The least determinant is in the subset that no exchange of one row improves, from the best of many draws.
    best = None
    for _ in range(300):
        own = set(rng.choice(n, h, replace=False).tolist())
        now = det(x[sorted(own)])
        while True:
            step = min(((det(x[sorted(own - {a} | {b})]), a, b) for a, b in itertools.product(own, set(range(n)) - own)), key=lambda t: t[0])
            if step[0] >= now * (1 - 1e-12):
                break
            now, own = step[0], own - {step[1]} | {step[2]}
        if best is None or now < best[0]:
            best = (now, own)
        if _ >= 3 and best[0] == now:
            break
    assert raw["det"] <= best[0] * 1.3 and raw["rows"] in range(h, h + 3)
    own = x[sorted(best[1])]
    factor = (h / n) / (1 - quality._upper(quality.chi2_quantile(h / n, 5), 7))
    inv = np.linalg.inv(quality.eased(np.cov(own.T, bias=True) * factor))
    d = np.einsum("ij,jk,ik->i", x - own.mean(0), inv, x - own.mean(0))
    got = np.einsum("ij,jk,ik->i", x - np.array(found["mu"]), np.array(found["inv"]).reshape(5, 5), x - np.array(found["mu"]))
    assert found["own"] and ((d > 30) == (got > 30)).all() and set(np.flatnonzero(got > 30)) == {3, 11, 17, 20}


def test_quality_by_group(spark):
    """Every (lang, source) of 25 rows is judged by itself; smaller ones lean on their language, and a small language on all."""
    rng = np.random.default_rng(5)
    words = lambda n, extra="": " ".join(w + extra for w in rng.choice(WORDS, n))
    rows = [(k, words(rng.integers(25, 60)), "en", "prose") for k in range(150)]
    rows += [(1000 + k, words(40, "#$") if k else words(40), "en", "code") for k in range(30)]  # marks are usual here
    rows += [(200 + k, words(40, "#$") if k == 2 else words(40), "en", "rare") for k in range(6)]
    rows += [(300 + k, words(40, "#$") if k == 1 else words(40), "xx", None) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stash = Stash(spark, "t")
    own = quality.estimates(quality._counted(df, stash, "bigint", "text", "doc_id", "lang", "source"), stash, 0.75, 1e-9, 3).collect()
    assert sorted(r["own"] for r in own) == [False, False, True, True]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df).collect()}
    assert {k for k, v in got.items() if not v} <= {1000, 202, 301} and not got[202] and not got[301]
    assert {r["doc_id"] for r in quality.keep_quality(df).collect()} == {k for k, v in got.items() if v}


def test_quality_of_repeats(spark):
    """Duplicate lines in changing order, and repeated passages, each short of the counted rules, are rejected on their own."""
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(WORDS, rng.integers(25, 60))), "en", "s0") for k in range(300)]
    short = [" ".join(rng.choice(WORDS, 3)) for _ in range(12)]
    rows.append((1000, "\n".join(short[i] for i in rng.integers(0, 12, 60)), "en", "s0"))
    passage = " ".join(rng.choice(WORDS, 15))
    rows.append((1001, " ".join([passage, *rng.choice(WORDS, 36), passage, *rng.choice(WORDS, 36)]), "en", "s0"))
    got = {r["doc_id"]: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000]["n_dup_lines"] >= 45 and got[1001]["n_dup_lines"] == 0 and got[1001]["n_repeat_words"] >= 29
    assert not got[1000]["base_failed"] and not got[1001]["base_failed"]
    assert {k for k, r in got.items() if not r["kept"]} == {1000, 1001}


def test_kneser_ney(docs, table):
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(docs, mark).collect()}
    tok = {k: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) + ["</s>"] for k, t in table.items()}
    u, b = Counter(), Counter()
    for k, t in tok.items():
        if not held(k):
            u.update(t)
            b.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(u.values()), len(u)
    ctx, ends = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (x, w), c in b.items():
        ctx[x][0] += c
        ctx[x][min(c, 3)] += 1
        ends[w] += 1
    d, e = (kneser_ney.discounts([sum(c == i for c in m.values()) for i in (1, 2, 3, 4)]) for m in (b, ends))
    total = sum(ends.values())
    rest = sum(e[min(c, 3)] for c in ends.values())
    low = lambda w: max(0, ends[w] - e[min(ends[w], 3)]) / total + rest / total / (v + 1)
    for k, t in tok.items():
        score = 0.0
        for x, w in zip(["<s>", *t[:-1]], t, strict=True):
            c = ctx.get(x)
            score += math.log10(low(w) if not c else max(0, b[x, w] - d[min(b[x, w], 3)]) / c[0] + sum(d[i] * c[i] for i in (1, 2, 3)) / c[0] * low(w))
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(t), sum(u[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((u[w] + 1) / (n + v + 1)) for w in t)) and r["score"] == pytest.approx(score)
    # Probabilities of all words after a context sum to one, with the unknown word.
    some = next(iter(ctx))
    mass = sum(max(0, b[some, w] - d[min(b[some, w], 3)]) / ctx[some][0] + sum(d[i] * ctx[some][i] for i in (1, 2, 3)) / ctx[some][0] * low(w) for w in [*u, "unseen"])
    assert mass == pytest.approx(1)


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", "<p>b</p>", None, "", "é" * 3000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    df = spark.createDataFrame([(k * 3, f"http://x/{k}\n" if k != 2 else None, h) for k, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    last = {}
    for k, h in enumerate(html):
        last[h or ""] = k * 3
    for k, h in enumerate(html):
        raw, top = (h or "").encode(), last[h or ""]
        r = got[k * 3]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == k * 3 else ("revisit", top))


def test_warc_dictionary_frame():
    records = [warc.make_record(k, f"http://x/{k}", (b"<html><body>%d text " % k) * 50, None) for k in range(300)]
    data = b"".join(warc.write_archive(iter(records), warc.build_dictionary(records)))
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME and len(data) < sum(map(len, records)) / 4


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = [bpe.round_trip_digests(empty, TOKENIZER), jaccard.jaccard_components(empty), token_files.token_file_round_trip(empty, TOKENIZER), langid.identify_languages(empty), secret_scan.scan_secrets(empty), quality.quality_verdicts(empty), packing.pack_documents(empty, TOKENIZER), kneser_ney.score_documents(empty, F.lit(False)), warc.archive_round_trip(pages), embed_dedup.near_duplicate_vectors(vectors)]
    assert [d.count() for d in made] == [0] * len(made)


def test_null_ids_and_repeats(spark):
    rows = [(None, "some words that are here", "en", "s"), (1, "some words that are here", "en", "s"), (1, "some words that are here", "en", "s"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for made in (bpe.round_trip_digests(df, TOKENIZER), jaccard.jaccard_components(df), token_files.token_file_round_trip(df, TOKENIZER), langid.identify_languages(df), secret_scan.scan_secrets(df), quality.quality_verdicts(df), kneser_ney.score_documents(df, F.lit(False))):
        assert made.count() == 4
    whole = packing.pack_documents(df, TOKENIZER).agg(F.sum("length"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()
    assert whole[0] == whole[1] and whole[0] > 4
    pages = spark.createDataFrame([(None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (None, None, None)], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 4
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embed_dedup.near_duplicate_vectors(vectors).collect()) == [(0, 0), (3, 1), (3, 1)]
