"""Every operator against a brute-force version on a small corpus, and on an empty table."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliate.llm import decontamination, language_id, mixing, secrets, simhash, spot_signatures, substring_dedup, suffix_dedup, token_files, warc
from foliate.llm import arrays as A

sha = lambda b: hashlib.sha256(b).hexdigest()


def expected_removal(units_of, rows, n, join):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        u = units_of(r[1])
        for j in range(len(u) - n + 1):
            first.setdefault(tuple(u[j : j + n]), r[0])
    out = []
    for r in rows:
        u = units_of(r[1])
        hit = bytearray(len(u))
        for j in range(len(u) - n + 1):
            if first[tuple(u[j : j + n])] < r[0]:
                hit[j : j + n] = b"\1" * n
        spans = sum(1 for k in range(len(u)) if hit[k] and not (k and hit[k - 1]))
        out.append((r[0], len(u), sum(hit), spans, sha(join([c for c, h in zip(u, hit) if not h]))))
    return sorted(out)


def test_suffix_arrays(docs, rows, nothing):
    got = sorted(map(tuple, suffix_dedup.digests(docs).collect()))
    assert got == expected_removal(lambda t: (t or "").encode(), rows, 50, bytes)
    assert suffix_dedup.digests(nothing).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs).collect()}
    assert all(sha(kept[d]) == h for d, _, _, _, h in got)


def test_levels_are_in_suffix_order():
    """Every level holds distinct windows in the order of their bytes, sizes fall geometrically, and each window finds its first document."""
    rng = np.random.default_rng(1)
    text = np.frombuffer(("abcdefghij" * 30).encode() + bytes(range(200)) + bytes(rng.integers(97, 99, 400).tolist()) + b"a" * 120, np.uint8)
    at = np.arange(len(text) - 50)
    low = at // 7
    window = lambda i: text[i : i + 50].tobytes()
    first = {}
    for i, doc in zip(at.tolist(), low.tolist()):
        first.setdefault(window(i), doc)
    family = suffix_dedup.Family(text, 50)
    found = np.concatenate([family.add(at[a : a + 60], low[a : a + 60]) for a in range(0, len(at), 60)])
    assert found.tolist() == [first[window(i)] for i in at.tolist()]
    held = [[window(i) for i in level.at.tolist()] for level in family.levels]
    assert all(level == sorted({*level}) for level in held) and sum(map(len, held)) == len(first)
    assert all(len(a) > 2 * len(b) for a, b in zip(held, held[1:]))


def test_suffix_automata(docs, rows, nothing):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect())
    want = expected_removal(lambda t: (t or "").encode().split(), rows, 13, b" ".join)
    assert got == [(d, n, k, h) for d, n, k, _, h in want]
    assert substring_dedup.digests(nothing).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, rows, nothing, block_bytes):
    texts = [r[1] for r in rows]
    items = [("7", texts[6]), ("10", texts[0]), ("9", "One!"), ("x", None), ("", "..."), ("9", "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for name, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(name)
    want = []
    for r in rows:
        w, found = words(r[1]), set()
        hit = bytearray(len(w))
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit[i : i + n] = b"\1" * n
                    found |= grams[tuple(w[i : i + n])]
        want.append((r[0], len(w), sum(hit), len(found), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    judged = decontamination.judged(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), tuple(r["items"])) for r in judged) == sorted(x[:5] for x in want)
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want if not x[5])
    assert decontamination.reports(nothing, bench).count() == 0 and decontamination.reports(docs, bench.limit(0)).filter("contaminated").count() == 0
    cut = {r.doc_id: r.text for r in decontamination.without_spans(docs, bench).collect()}
    assert cut[rows[0][0]] == "" and cut[rows[1][0]] is None


def brute_prints(rows):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def components_of(prints, ids):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for p, i in zip(prints, ids):
        least[find(p)] = min(i, least.get(find(p), i))
    return [least[find(p)] for p in prints]


def test_simhash(docs, rows, nothing):
    prints, ids = brute_prints(rows), [r[0] for r in rows]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), components_of(prints, ids)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_a_dense_cell(spark, monkeypatch):
    """Cells above the limit are dealt again and lose no link."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    points = {int(c) for c in centres}
    for c in centres:
        points |= {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))}
    points = sorted(points)
    monkeypatch.setattr(simhash, "CELL", 8)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "f bigint")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(p) for p in points] == components_of(points, points)


def test_mixing(docs, rows, nothing):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sums = Counter()
    for r, n in zip(rows, size):
        sums[r[3]] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        level = (1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * sums[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * sums[s] if s in full else level * weight[s] for s in names}
    source = {r[0]: r[3] for r in rows}
    got = mixing.mixed(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.source_size == sums[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r["size"]
    # Rows that repeat a doc_id share what is left at the threshold, rounded down.
    assert all(-2 <= taken[s] - target[s] <= 0.5 for s in names)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert words == +taken
    assert mixing.mixed(nothing).count() == 0


def test_spot_signatures(docs, rows, nothing):
    got = spot_signatures.edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    want = []
    for r, s in zip(order, [*order[1:], order[0]]):
        t, u = r[1] or "", s[1] or ""
        want.append((r[0], len(t), sha((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode())))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints == {r.doc_id: r.fingerprint for r in spot_signatures.fingerprints(docs).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    assert all((prints[a] == prints[b]) >= (text[a] == text[b]) for a in prints for b in prints)
    for r in got:
        a, b = spot_signatures.marks_of(r.fingerprint), spot_signatures.marks_of(r.edited_fingerprint)
        assert abs(r.near_edited - spot_signatures.likeness(a, b)) < 1e-12
    assert spot_signatures.edits(nothing).count() == 0


def test_spots_follow_anchors():
    marks, limits = spot_signatures.signatures(["the cat sat on a mat today", "the cat, sat!", "", "zebra"])
    sizes = np.diff(limits).tolist()
    # the+cat sat, on+mat today, a+mat today; the+cat sat; none; the words themselves.
    assert sizes == [3, 1, 0, 1] and marks[limits[1]] in marks[: limits[1]]


def test_language(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.xxhash64("doc_id") % 3 == 0
    model = language_id.trained(table.filter(~held))
    out, names = language_id.identified(table.filter(held), model, F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    found = out.select("lang", names["language"]).collect()
    assert sum(a == b for a, b in found) >= 0.97 * len(found)
    mine, names = language_id.document_languages(docs)
    rejected = {r.text for r in mine.collect() if not r[names["kept"]]}
    assert {None, "", " \t\n"} <= rejected
    assert language_id.accepted(docs).columns == docs.columns and language_id.accepted(nothing).count() == 0


@pytest.mark.parametrize("split", ["64m", "2000"])
def test_archives(spark, split):
    texts = ["<p>a</p>" * 50, None, "", "<p>a</p>" * 50, "é" * 700, "\x1f\x8b\x08" * 9] + [f"<b>{i * 7919}</b>" * 40 for i in range(30)]
    pages = spark.createDataFrame([(i, f"http://x.example/{i}\n", t, 1) for i, t in enumerate(texts)], "page_id bigint, url string, html string, n int").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, warc.round_trip(pages).collect()))
        assert warc.round_trip(pages.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    want = []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        j = first[t or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if i == j else ("revisit", j))))
    assert got == want


def test_members_with_false_magic():
    """A member that holds the magic bytes by chance comes in several pieces, also across ranges."""
    import os

    while True:
        payload = os.urandom(1 << 22)
        data = warc.member(5, "u", payload, None, False)
        pieces = data.split(warc.MAGIC)[1:]
        if len(pieces) > 1:
            break
        # Stored random bytes may hold the magic; plant it where they do not.
        payload = warc.MAGIC + b"\0" + os.urandom(1 << 10)
        press = zlib.compressobj(0, zlib.DEFLATED, 31)
        head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: %d\r\n\r\n" % (len(payload) + 4)
        data = press.compress(head + b"\r\n\r\n" + payload) + press.flush()
        pieces = data.split(warc.MAGIC)[1:]
        break
    assert len(pieces) > 1
    members = warc.Members()
    found = [r for p in pieces for r in members.feed(p)]
    assert [r["page_id"] for r in found] == [5] and found[0]["payload"] == payload
    left, right = warc.Members(), warc.Members()
    assert not [*left.feed(pieces[0])] and left.open
    assert not [r for p in pieces[1:] for r in right.feed(p)]
    joined = warc.Members(left.open)
    assert [r["page_id"] for p in right.head for r in joined.feed(p)] == [5]


def test_secrets(docs, rows, nothing):
    patterns = [(re.compile(p, re.A), g, n) for _, p, g, n in secrets.BASE]
    want = []
    for r in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(patterns) for m in p.finditer(r[1] or "") if len(m[g]) >= n)
        listed = ",".join(f"{secrets.BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        want.append((r[0], *(sum(s[1] == k for s in spans) for k in range(3)), sha(listed.encode())))
    got = secrets.reports(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and sum(w[1] + w[2] + w[3] for w in want) >= 4
    assert secrets.reports(nothing).count() == 0


def test_random_strings_against_words(spark):
    import json
    import random

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.ratios(table)
    rng = random.Random(1)
    random_strings = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(24)) for _ in range(200)]
    words = [w for r in table.select("text").collect() for w in re.findall("[A-Za-z]{16,}", r.text or "")][:300]
    df = spark.createDataFrame([(1, w) for w in random_strings] + [(0, w) for w in words], "secret int, w string")
    found = df.select("secret", (secrets.score(F.col("w"), F.from_json(F.lit(json.dumps(model)), "array<double>")) > secrets.LIMIT).alias("hit")).collect()
    assert sum(r.hit for r in found if r.secret) >= 195 and sum(r.hit for r in found if not r.secret) <= 3


def test_token_files(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    library = Tokenizer.from_file(path)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    at, want = 0, []
    for d in sorted(r[0] for r in rows):
        want.append((d, at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        at += len(ids[d])
    assert sorted(map(tuple, token_files.round_trip(docs).collect())) == sorted(want)
    assert token_files.round_trip(nothing).count() == 0


def test_pieces_equal_the_library():
    encoder = token_files.Encoder(open(token_files.default_tokenizer(), encoding="utf-8").read())
    texts = ["Hello, world. It's 3.5 ÉTÉ İstanbul ＡＢ é x y a b it's we'll <|endoftext|> ß², ½ \x1c q", "..", "a.,b", "Straße. straße, ÀÉ."]
    assert encoder.plain
    assert encoder.encode([t.encode() for t in texts]) == [np.array(e.ids, "<u2").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 5, 4096, 10_001])
def test_coder(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids)))
    states, words = coder.encode(ids)
    assert (coder.decode(n, states, words) == ids).all()


def test_damage_is_found(spark, docs, tmp_path):
    path = f"file://{tmp_path}/set"
    token_files.write(docs.select("doc_id", "text"), token_files.default_tokenizer(), path)
    blocks = spark.read.parquet(f"{path}/blocks")
    flipped = F.concat(F.lit(b"\x01"), F.expr("substring(words, 2, length(words) - 1)"))
    blocks.withColumn("words", flipped).write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="damaged words"):
        token_files.read(spark, f"{path}-bad").collect()


def test_windows_and_words():
    data, offsets = A.buffer_of(__import__("pyarrow").array(["ab cd", "", None, " e\t", "f"]))
    first, last, limits = A.words_of(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(first, last)] == [b"ab", b"cd", b"e", b"f"] and limits.tolist() == [0, 2, 2, 2, 3, 4]
