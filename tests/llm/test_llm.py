"""The training-data operators against brute force, on small hand-made tables with nulls, ties, repeats and clashing columns."""

import bisect
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from affinis.llm import embeddings, mixing, neighbours, packing, quality, simhash, suffix, token_files, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, fp int"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgé"), rng.integers(1, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 3, 40, 90, 200, 260)]
    near = base[4] + " tail"
    long = " ".join(word() for _ in range(6000))
    return [None, "", base[0], base[1], base[2], base[3], base[3], base[4], near, base[5], base[4][:450] + "|" + base[5][:450], "aa " * 300, long, "\x1f  \x85", "Über  DIE\n\nmaß"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", 1, "x", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "lost id", None, None, None, None, None)], DOCS)


def test_token_ids_equal_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from affinis.llm.tokens import default_path, encoder

    own = Tokenizer.from_file(default_path())
    for t in ("<|endoftext|>", "hi <|endoftext|> there", "a<|endoftext|><|endoftext|> b", "<|endoftext| >", "é <|endoftext|>日本"):
        assert encoder(default_path()).encode(t).tolist() == own.encode(t, add_special_tokens=False).ids
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("hi <|endoftext|> there")}))
    token_files.write_tokens(docs, str(tmp_path / "out"))
    got = token_files.read_tokens(spark, str(tmp_path / "out")).collect()
    want = [[*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()]
    assert sorted(r.ids for r in got) == sorted(want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_no_documents(spark, docs, tmp_path):
    none = docs.limit(0)
    token_files.write_tokens(none, str(tmp_path / "none"))
    assert not token_files.read_tokens(spark, str(tmp_path / "none"), digest=True).collect()
    assert not packing.pack(packing.pieces(none)).collect()
    assert not simhash.groups(none).collect()
    assert not suffix.kept_parts(none).collect()
    assert not mixing.mix(none).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_variable_length_code_round_trip(n):
    ranks = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert (token_files.decode_ranks(control, data, n) == ranks).all()


@pytest.mark.parametrize("lengths", [[], [0], [3, 0, 4, 1, 9], [1] * 50, [0, 0, 5000, 2]])
def test_variable_length_code_of_several_documents(lengths):
    n = np.array(lengths, dtype=np.int64)
    ranks = np.random.default_rng(len(n)).choice([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], n.sum()).astype(np.uint32)
    control, data, control_ends, data_ends = token_files.encode_all(ranks, n)
    assert (token_files.decode_all(control, data, n) == ranks).all()
    at = np.append(0, np.cumsum(n))
    for k in range(len(n)):
        own = control[([0, *control_ends][k]) : control_ends[k]].tobytes(), data[([0, *data_ends][k]) : data_ends[k]].tobytes()
        assert own == token_files.encode_ranks(ranks[at[k] : at[k + 1]])


def best_fit_decreasing(sizes, length=1024):
    gaps, used = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        used += k == len(gaps)
        gap = gaps.pop(k) if k < len(gaps) else length
        if gap > size:
            bisect.insort(gaps, gap - size)
    return used


@pytest.mark.parametrize("sizes", [[], [1024] * 40, [1] * 3000, [513] * 50 + [511] * 20, "any", "small"])
def test_packing_is_gapless_and_as_tight_as_best_fit(spark, sizes):
    rng = np.random.default_rng(0)
    sizes = {"any": rng.integers(1, 1025, 3000), "small": rng.integers(1, 90, 5000)}.get(sizes, sizes) if isinstance(sizes, str) else sizes
    rows = [(k, int(n), f"x{k}", 3) for k, n in enumerate(sizes)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, chunk string, piece_number int"))
    assert packed.columns == ["doc_id", "length", "chunk", "piece_number", "sequence_id", "offset"]
    got = packed.collect()
    assert sorted((r.doc_id, r.length, r.chunk, r.piece_number) for r in got) == rows
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 1024
    # each task of a round may leave a sequence open
    assert len(places) <= best_fit_decreasing([r[1] for r in rows]) + 8


def test_sweep_takes_the_least_gap_that_holds():
    where, offsets, left = packing.sweep([6, 5, 5, 2], [(9, 1), (6, 2), (5, 3)], None, 10)
    assert (where, offsets) == ([2, 3, 1, 1], [4, 5, 1, 6]) and sorted(left) == [(2, 1)]
    assert packing.sweep([7, 4], [], [50, 51], 10)[0] == [50, 51] and packing.sweep([7, 3], [], [50, 51], 10)[0] == [50, 50]
    assert packing.sweep([7], [], None, 10) == ([-1], [0], [])


def test_a_piece_that_fits_no_sequence_raises(spark):
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, 1025)], "doc_id long, length long")).collect()


def test_pieces_cover_each_document(docs):
    from affinis.llm.tokens import default_path, encoder

    e = encoder(default_path())
    rows = packing.pack(packing.pieces(docs, with_ids=True).drop("ids")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.where("doc_id IS NOT NULL AND doc_id <> 4").collect():
        ids = [*e.encode(d.text).tolist(), 2]
        own = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for r in own)


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    ones = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def test_fingerprints_and_groups(docs, texts):
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    rows = docs.where("doc_id IS NOT NULL").collect()
    fp = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    label = {k: k for k in fp}
    for _ in fp:
        label = {a: min(label[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4) for a in fp}
    got = {r.doc_id: r.component_id for r in simhash.groups(docs).collect() if r.doc_id is not None}
    assert got == label
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(label.values()))


def test_keep_one_keeps_one_row_of_each_group_without_unique_ids(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60))
    a, b, c, e, f = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, e), (7, e), (7, f), (8, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(8, a), (None, b), (None, c), (7, e), (7, f)], key=str)


def test_crowded_leading_bits_are_parted(spark, monkeypatch, docs):
    whole = sorted(map(str, simhash.groups(docs).collect()))
    monkeypatch.setattr(simhash, "HOT", 0.001)
    assert sorted(map(str, simhash.groups(docs).collect())) == whole


@pytest.mark.parametrize("passes", [1_000_000, 500])
def test_ball_hashing_finds_every_link(monkeypatch, passes):
    monkeypatch.setattr(simhash, "PASS", passes)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for k in range(30):
        bits = rng.choice(64, rng.integers(1, 7), replace=False)
        fps[30 + k] = fps[k] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
    lead = 4
    joined = set()
    for bucket in range(16):
        off = np.bitwise_count((fps >> np.uint64(60)) ^ np.uint64(bucket))
        own = fps[off <= 2]
        joined |= {(int(own[a]), int(own[b])) for a, b in zip(*simhash.chained(own, bucket, lead), strict=True)}
    group = {int(f): int(f) for f in fps}
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in joined:
        group[find(a)] = find(b)
    for a in map(int, fps):
        for b in map(int, fps):
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_strings_with_equal_polynomials_are_no_repeats(spark):
    # a polynomial modulo 2^64 gives both texts one hash
    start = "rxahwmghkwzmuunhdyugylprszvpgzbkfsldxeghdqjrbiqfebryghdasfhhjntppykdrlps"
    turns = [bin(i).count("1") & 1 for i in range(32)]
    rows = [(n, start + "".join(parts[x] for x in turns)) for n, parts in enumerate((("aajw", "uvtw"), ("uvtw", "aajw")))]
    got = suffix.kept_parts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_windows_with_equal_keys_are_compared_on_their_bytes():
    data = np.frombuffer(b"abcdabcdabcx", dtype=np.uint8)
    at = np.array([0, 4, 8])
    assert suffix.repeated(data, at, np.zeros(3, dtype=np.uint64), 4).tolist() == [0, 1]
    assert suffix.repeated(data, at, np.array([1, 1, 2], dtype=np.uint64), 4).tolist() == [0, 1]


def test_stages_keep_columns_of_any_name(spark, texts):
    names = ["doc", "th", "z", "starts", "kept", "n_bytes", "row", "caller", "k_th", "r_id", "skey", "h", "toxic_score", "toxic_score_", "copy", "left"]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.without_toxic(d, labels, 2.0), simhash.keep_one, suffix.without_repeats, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


@pytest.mark.parametrize("group", [5_000, 1])
def test_repeated_strings(monkeypatch, docs, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    count = {}
    for b in data:
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    want = []
    for r, b in zip(rows, data, strict=True):
        cover = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                cover[k : k + 200] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~cover].tobytes()
        want.append((r.doc_id, len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix.kept_parts(docs).select("caller.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix.without_repeats(docs).columns == docs.columns


def test_mix_takes_what_it_should(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)


def plain(rows, digits=6):
    return sorted(str(tuple(round(x, digits) if isinstance(x, float) else x for x in r)) for r in rows)


def test_mix_agrees_with_sql_at_every_shard_size(spark, docs, monkeypatch):
    for shard in (16_384, 7):
        monkeypatch.setattr(mixing, "SLOTS", shard)
        db = duckdb.connect()
        db.register("documents", docs.select("doc_id", "text", "source").toArrow())
        plan = mixing.mix
        monkeypatch.setattr(mixing.mixture, "__defaults__", (shard,))
        assert plain(map(tuple, plan(docs).collect())) == plain(db.sql(mixing._oracle()).fetchall())


def test_reputations_agree_with_sql(spark):
    urls_ = [f"http://h{k % 7}.{d}/{'de' if k % (j + 2) else 'fr'}/{k}" for j, d in enumerate(("bad.com", "good.com", "x.co.uk", "plain.net")) for k in range(30)]
    urls_ += [f"http://h{k}.bad.com/other" for k in range(9)] + ["http://h1.bad.com/other"] * 3 + [None, "nothing", "http://", "HTTP://A.BAD.COM"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls_)], "page_id long, url string, bound int")
    db = duckdb.connect()
    db.register("pages", pages.toArrow())
    got = urls.filter_urls(pages)
    assert plain(map(tuple, got.collect())) == plain(db.sql(urls.OP5_SQL).fetchall())
    assert {r.verdict for r in got.where("rule IS NULL").collect()} == {"allow", "block"}
    assert not urls.filter_urls(pages.limit(0)).collect()


def test_url_rules(spark):
    pages = spark.createDataFrame(
        [(1, "http://WWW.Example.org/es/x?y"), (2, "https://example.org/en/12#z"), (3, "http://a.com/de/"), (4, "http://a.net"), (5, None), (6, "no scheme"), (7, "x://org"), (8, "x://org/")], "page_id long, url string"
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got[1] == ("www.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block") and got[4][:3] == ("a.net", "", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][:3] == ("org", "", None) and got[8][2:] == ("org/", "allow")


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.toxic_score < 0.3 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.without_toxic(docs, none).columns == docs.columns
    assert quality.fit(quality.measured(docs), none).score(np.zeros((1, quality.STATS))).tolist() == [0.5]


def slow_fit(x, y):
    """Ridge over the same random features on all rows at once, then isotonic regression on the rows themselves."""
    m = quality.Model(x.mean(axis=0), np.maximum(1e-6, x.std(axis=0)))
    z = m.features(x)
    m.weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) * np.eye(quality.FEATURES) / quality.FEATURES, z.T @ y)
    r = m.raw(x)
    order = np.argsort(r, kind="stable")
    m.x, m.y = quality.isotonic(r[order], np.ones(len(x)), y[order])
    return m


def test_quality_fit_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(20, 60))) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!!", "||", "$$$", "aaaaaa"]) for _ in range(rng.integers(5, 40)))
    rows = [(k, good() if k % 2 else bad()) for k in range(400)] + [(1, "copy of an id"), (None, "no id"), (1001, None), (1002, ""), (1003, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(5, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.measured(docs).collect()
    train = [(s, r.doc_id % 2) for r in stats if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for s in [r.stats]]
    plain_model = slow_fit(np.array([s for s, _ in train], dtype=np.float64), np.array([float(y) for _, y in train]))
    model = quality.fit(quality.measured(docs), labels)
    x = np.array([r.stats for r in stats], dtype=np.float64)
    assert np.allclose(model.raw(x), plain_model.raw(x), atol=1e-6)
    assert np.abs(model.score(x) - plain_model.score(x)).max() < 0.1
    held = [(model.score(np.array([r.stats]))[0] >= 0.7) == bool(r.doc_id % 2) for r in stats if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 1 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(held) > 0.95 and np.isfinite(model.score(x)).all()


def toxic_rows():
    rng = np.random.default_rng(5)
    out = []
    for k in range(400):
        bad, said = k % 3 == 0, rng.random() < (0.7 if k % 3 == 0 else 0.1)
        out.append((k, " ".join(["plain", "words", str(rng.choice(["tree", "river"]))] + ["vilely"] * (bad and rng.random() < 0.9) + ["muslims"] * bool(said)), int(bad)))
    return out


def test_toxicity_fit_equals_a_plain_one(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    weights, intercept = toxicity.fit(docs, labels)
    train = [(set(toxicity.features(t)), y, t) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    names = list(weights)
    x = np.array([[f in own for f in names] for own, _, _ in train], dtype=np.float64)
    y = np.array([float(y) for _, y, _ in train])
    # the same loss, gradients by whole matrices: swaps as rows of differences
    swaps = []
    for own, _, t in train:
        for m in toxicity.mentions(t):
            for terms in toxicity.IDENTITY:
                for other in terms if m in terms else ():
                    if other != m:
                        has = lambda w: np.array([f in toxicity.word_features(w) for f in names], dtype=np.float64)
                        swaps.append((has(other) - has(m)) / np.sqrt(len(terms) - 1))
    d = np.array(swaps).reshape(-1, len(names))
    w, b = np.zeros(len(names)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m1, v1 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, 401):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.append(x.T @ (p - y) / len(y) + 2e-5 * w + 2 * d.T @ (d @ w) / len(y), (p - y).mean())
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.999 * v1 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(v1 / (1 - 0.999**k)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    assert np.allclose(w, list(weights.values()), atol=1e-6) and abs(b - intercept) < 1e-6
    held = [r for r in toxicity.score(docs, (weights, intercept)).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.toxic_score >= 0.3) == (r.doc_id % 3 == 0) for r in held]) > 0.85


def test_toxicity_fits_one_row_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(k % 30, f"text {k}") for k in range(600)] + [(None, "x"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    rows = toxicity.fit_rows(docs, labels, 8).collect()
    assert len(rows) == 8 and len({r.doc_id for r in rows}) == 8
    long = spark.createDataFrame([(1, "word " * 50_000), (2, ""), (3, None)], "doc_id long, text string")
    scored = toxicity.score(long, toxicity.fit(docs, labels)).collect()
    assert len(scored) == 3 and all(0 <= r.toxic_score <= 1 for r in scored)
    none = docs.limit(0)
    assert not toxicity.without_toxic(none, labels).collect() and not quality.measured(none).collect()


def test_identity_swaps_do_not_move_the_score(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(400):
        bad, said = k % 3 == 0, rng.random() < (0.7 if k % 3 == 0 else 0.1)
        rows.append((k, " ".join(["plain", "words", str(rng.choice(["tree", "river"]))] + ["vilely"] * (bad and rng.random() < 0.9) + ["muslims"] * bool(said))))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    s = toxicity.Scorer(model[0])
    assert s.of("vilely") > s.of("muslims") + 1 and abs(s.of("plain words muslims") - s.of("plain words christians")) < 1.0


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[:60] + 0.03 * rng.normal(size=(60, 16))
    x[260:] = x[5] + 0.02 * rng.normal(size=(40, 16))
    x[299] = x[298]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, []), (1004, [1.0])]
    return x, spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("shard", [4096, 60])
def test_embedding_links_are_complete(monkeypatch, cloud, shard):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    x, rows = cloud
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[n].min() for n in near])
    got = {r.vec_id: r for r in embeddings.near_duplicates(rows).collect()}
    assert len(got) == len(x) + 5
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum() - 1, label[k], bool(label[k] == k))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(1000, 1005))


@pytest.mark.parametrize("block", [12_000, 40])
def test_embedding_links_between_shards(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "SHARD", 40)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    # close to the bound and without a clear nearest centre: few linked pairs share one
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(200, 12))
    away -= (away * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    x[200:] = 0.951 * x[:200] + np.sqrt(1 - 0.951**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [(got[k].n_links, got[k].component_id) for k in range(len(x))] == [(int(near[k].sum()) - 1, label[k]) for k in range(len(x))]


@pytest.mark.parametrize("block", [12_000, 2])
def test_embedding_chains_stay_whole(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    # 15 degrees apart: only neighbours of a chain are linked
    chains = [(1, 3, 4, 2), (13, 11, 14, 12, 15), (24, 23, 22, 21)]
    rows = []
    for c, chain in enumerate(chains):
        for step, k in enumerate(chain):
            v = np.zeros(6)
            v[2 * c], v[2 * c + 1] = np.cos(np.radians(15 * step)), np.sin(np.radians(15 * step))
            rows.append((k, v.tolist()))
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for chain in chains:
        assert {(got[k].component_id, got[k].kept) for k in chain} == {(min(chain), False), (min(chain), True)}
        assert [got[k].n_links for k in chain] == [1, *[2] * (len(chain) - 2), 1]


def test_nearest_neighbours_recall(cloud):
    x, rows = cloud
    got = neighbours.search(rows, F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        hit += len({r.vec_id for r in own} & set(np.argsort(-s, kind="stable")[:20]))
    assert hit / (20 * 15) >= 0.9


def test_embedding_rows_with_equal_or_null_ids(spark):
    axis = lambda k: [float(i == k) for i in range(6)]
    near = lambda k: [1.0 if i == k else 0.1 * (i == (k + 1) % 6) for i in range(6)]
    rows = [(2, axis(0)), (2, axis(2)), (7, near(0)), (8, near(2)), (9, axis(4)), (None, axis(4)), (None, [0.0] * 6)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(str, (tuple(r) for r in got.drop("audit_recall").collect()))) == sorted(
        map(str, [(2, 1, 2, True), (2, 1, 2, True), (7, 1, 2, False), (8, 1, 2, False), (9, 1, 9, True), (None, 1, 9, False), (None, 0, None, True)])
    )
    assert {r.audit_recall for r in got.collect()} == {1.0}
    assert not embeddings.near_duplicates(got.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")).limit(0)).collect()


def test_links_of_two_levels_of_centres(spark, monkeypatch, cloud):
    monkeypatch.setattr(embeddings, "SHARD", 10)
    monkeypatch.setattr(embeddings, "CENTRES", 4)
    test_embedding_links_are_complete(monkeypatch, cloud, 10)


def test_neighbours_ties_repeated_ids_and_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.5, 0.0]), (20, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 3).collect()]
    one = [(20, 1, 1, 1.0), (20, 2, 3, 1.0), (20, 3, 2, 0.5)]
    two = [(20, 1, 1, 0.0), (20, 2, 2, 0.0), (20, 3, 3, 0.0)]
    assert sorted(got) == sorted(one + two)
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") == 1).collect()]
    assert sorted(got) == [(1, 1, 3, 1.0), (1, 2, 20, 1.0), (1, 3, 2, 0.5), (1, 4, 20, 0.0)]
    assert not neighbours.search(df.limit(0), F.col("vec_id") == 1).collect()
    assert not neighbours.search(df.where("vec_id = 1"), F.col("vec_id") == 1).collect()


@pytest.mark.parametrize("most", [16_384, 30])
def test_neighbours_in_parts(monkeypatch, cloud, most):
    monkeypatch.setattr(neighbours, "GROUP", most)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    test_nearest_neighbours_recall(cloud)


def test_pipeline_runs_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = [f"w{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    passage = text(60)
    rows = [(k, text(80), "en", f"s{k % 3}", 1, "x") for k in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 1, "x"), (101, text(20) + " " + passage, "en", "s1", 1, "x"), (102, passage + " " + text(30), "en", None, 1, "x")]
    rows += [(200 + k, "vilely hateful slurs " + text(30), "en", "s1", 1, "x") for k in range(30)] + [(None, None, None, None, None, None), (None, text(50), "en", "s2", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "chunk"]
    ids = lambda df: {r.doc_id for r in df.collect()}
    # a classifier fitted on 70 rows
    assert len(ids(seen[0]) & set(range(200, 230))) <= 3 and len(set(range(60)) - ids(seen[0])) <= 3
    assert 100 not in ids(seen[1]) and ids(seen[1]) == ids(seen[0]) - {100} and seen[1].where("doc_id IS NULL").count() == seen[0].where("doc_id IS NULL").count() > 0
    assert not any(passage in (r.text or "") for r in seen[2].collect()) and seen[2].count() == seen[1].count()
    taken = sum(len((r.text or "").split()) for r in seen[3].collect())
    assert abs(taken - 1.5 * sum(len((r.text or "").split()) for r in seen[2].collect())) < 300
    last = seen[4].collect()
    assert sorted((tuple(r) for r in seen[4].drop("sequence_id", "offset").collect()), key=str) == sorted((tuple(r) for r in packing.pieces(seen[3]).collect()), key=str)
    assert {tuple(sorted(r.asDict())) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {tuple(sorted(r.asDict())) for r in last}
