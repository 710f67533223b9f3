"""The numbered operators against brute force, on the smallest tables and on a table of odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import decontaminate, html_text, kneser_ney, language, minhash, quality, recompression, registry, sentencepiece_bpe, suffix_array, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen the quick brown fox jumps over a lazy dog again and again"
#: Two words of 1,024 bytes whose polynomial hashes modulo 2**64 agree, whatever the base.
THUE = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]
HELD = next(i for i in range(30, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
TWELVE = " ".join(f"w{k}" for k in range(12))
ODD = [
    (1, PASSAGE, "en"), (2, PASSAGE, "en"), (2, PASSAGE, "en"), (3, None, None), (4, "", "de"), (5, "  \n\t ", "en"), (6, "a", "fr"), (7, "é ü ß 日本語 テキスト 🙂 \u0000x", "de"),
    (8, "start " + PASSAGE + " end\nx\nx\n" + PASSAGE, None), (9, "spam " * 3000, "en"), (10, ("q" * 70_000) + " tail", "en"), (None, PASSAGE, "en"), (None, None, None), (-5, "One TWO three", "en"), (11, "1234 #$% && <|> ***", "xx"),
    (20, THUE[0], "en"), (21, THUE[1], "en"), (22, f"{TWELVE} {THUE[0]}", "en"), (23, f"{TWELVE} {THUE[1]}", "en"), (HELD, f"new {THUE[1]} {TWELVE}", "en"),
]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "hot", 1, "k", "n", "w", 7, 8) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node string, words string, h int, row int")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "real"])
def docs(request):
    return request.getfixturevalue(request.param)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(df, columns, expected):
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert ours == sorted(expected, key=repr)


def test_op1_base(spark, docs, sf_dir):
    out = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    expected = []
    for i, t in texts(docs):
        w, lines = WORD(t or ""), [x for x in (t or "").split("\n") if WORD(x)]
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    same(out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], expected)
    assert not out.filter("kept AND base_failed").count()


def test_op1_keeps_trusted(spark, real, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality.quality_rules(real, labels).filter("NOT base_failed").join(labels.filter("quality = 1 AND toxic = 0"), "doc_id")
    assert good.filter("NOT kept").count() <= 0.02 * good.count()


def test_op1_verdict_brute_force(spark, real, sf_dir):
    import struct

    import xxhash

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)

    def grams(words):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
        pairs = [of_long(b, of_long(a, 42)) for a, b in zip(h, h[1:])] + [of_long(a, 42) for a in h[-1:]]
        return [x % 8192 for x in h] + [signed(x) % 8192 for x in pairs]

    rows = [(i, WORD(t or "")) for i, t in texts(real)]
    found = {i: grams(w) for i, w in rows}
    raw, target = Counter(range(8192)), Counter(range(8192))
    for i, g in found.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    shift = math.log(sum(target.values())) - math.log(sum(raw.values()))
    weight = [math.log(target[b]) - math.log(raw[b]) - shift for b in range(8192)]
    mean = {i: sum(weight[b] for b in found[i]) / max(2 * len(w), 1) for i, w in rows}
    known = sorted(math.floor(mean[i] / 0.001) for i, w in rows if i in trusted and len(w) >= 20)
    threshold = known[int(0.005 * len(known))] * 0.001
    out = quality.quality_rules(real, labels).collect()
    assert len({r.threshold for r in out}) == 1 and abs(out[0].threshold - threshold) <= 0.0011
    for r in out:
        assert math.isclose(r.score, mean[r.doc_id], rel_tol=1e-5, abs_tol=1e-6)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)


def test_op2_round_trip_of_payloads(spark, tmp_path):
    big = "".join(chr(0x100 + k % 5000) for k in range(60_000))
    rows = [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", "x" * 200), (5, "u", "short"), (6, "u", "short"), (7, "u\r\nX: y", "a\r\n\r\nWARC/1.1" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    back = {r.id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert len(back) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert back[i].digest == sha(data) and back[i].payload_bytes == len(data)
        assert back[i].record_type == "revisit" and back[i].refers_to == 1 if i == 2 else bytes(back[i].payload) == data
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_op2_foreign_archives(spark, tmp_path):
    import base64
    import gzip

    def record(kind, block, *more, name="<urn:x:1>"):
        head = [f"WARC-Type:{kind}", f"WARC-RECORD-ID: {name}", *more, f"content-length: {len(block)}"]
        return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING: Chunked\r\n\r\n" + warc.chunked(body, 5)
    data = record("warcinfo", b"software: x\r\n") + record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request") + record("response", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://a/") + record("metadata", b"a: b")
    data += record("response", http[:20], "WARC-Segment-Number: 1", "Content-Type: application/http", name="<urn:x:9>") + record("continuation", http[20:], "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:x:9>", f"WARC-Segment-Total-Length: {len(http)}")
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = [(r.record_type, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted([("warcinfo", b"software: x\r\n"), ("request", b""), ("response", body), ("metadata", b"a: b"), ("response", body)])
    with pytest.raises(ValueError):
        warc.dechunked(warc.chunked(body, 5)[:-2])
    with pytest.raises(ValueError):
        warc.decode_record({"warc-type": "resource", "warc-payload-digest": "sha256:" + "0" * 64}, body)


def test_op3_equals_library(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = []
    for i, t in texts(docs):
        ids = library.encode(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    same(sentencepiece_bpe.encode(docs, path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)


def test_op4_held_out_accuracy(real):
    out = language.language_of_documents(real).join(real.select("doc_id", "lang", "text"), "doc_id").filter("lang IS NOT NULL AND length(text) > 100").collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)


def test_op4_odd_rows(odd):
    out = [r for r in language.language_of_documents(odd).collect()]
    assert len(out) == len(ODD)
    und = sorted((r.doc_id for r in out if r.lang_pred == "und"), key=repr)
    assert und == sorted([3, 4, 5, 11, None], key=repr)


def test_op5_brute_force(docs):
    rows = [(i, (t or "").encode()) for i, t in texts(docs)]
    first = {}
    for i, b in sorted({r for r in rows if r[0] is not None}):
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    expected = []
    for i, b in rows:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 99):
                if first[b[k : k + 100]] != (i, k):
                    gone[k : k + 100] = b"\x01" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same(suffix_array.remove_repeats(docs), columns, expected)
    same(suffix_array.remove_repeats(docs, split=2), columns, expected)  # anchors of three contexts and more meet across shards


def test_op6_brute_force(docs):
    rows = [(i, WORD(t or "")) for i, t in texts(docs)]
    first = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(i, first.get(key, i))
    expected = []
    for i, w in rows:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone.update(range(k, k + 13))
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    same(recompression.remove_repeats(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected)


def test_word_hashes_of_made_words():
    import numpy as np

    from graphloom.llm import textops

    for words in (THUE, [x[:512] for x in THUE], ["ab" * 40, "ba" * 40], ["x" * 64 + "y", "y" + "x" * 64], ["a" * 65, "a" * 64]):
        raw = " ".join(words).encode()
        starts, ends, _ = textops.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for which in (0, 1):
            one, two = textops.word_hashes(np.frombuffer(raw, np.uint8), starts, ends, which).tolist()
            assert one != two
            alone = textops.word_hashes(np.frombuffer(words[0].encode(), np.uint8), np.array([0]), np.array([len(words[0])]), which)
            assert one == int(alone[0])  # also beside shorter words, where values are looked up
    short = np.frombuffer(b"word", np.uint8)
    mixed = np.frombuffer(b"word " + b"q" * 100, np.uint8)
    assert textops.word_hashes(short, np.array([0]), np.array([4]))[0] == textops.word_hashes(mixed, np.array([0, 5]), np.array([4, 105]))[0]


def test_op6_windows_around_dead_symbols_are_not_repeated():
    """Rounds by hand: only windows that two texts share stay, and of the shared ones none goes."""
    import random

    import numpy as np

    from graphloom.llm import recompression as R

    class Names:
        def __init__(self, keys):
            self.keys = np.array(sorted(keys), np.uint64)

        def find(self, asked):
            at = np.minimum(np.searchsorted(self.keys, asked), max(len(self.keys) - 1, 0))
            return [np.where(self.keys[at] == asked, at, -1) if len(self.keys) else np.full(len(asked), -1)]

    rng = random.Random(5)
    shared = [rng.randrange(40) for _ in range(60)]
    texts = [[rng.randrange(1000) for _ in range(50)] + shared + [rng.randrange(1000)] * 5, [7] * 20 + shared[5:50] + [rng.randrange(1000) for _ in range(40)], [rng.randrange(30) for _ in range(200)]]
    words = np.array([w * 0x9E3779B97F4A7C15 % 2**64 for t in texts for w in t], np.uint64)
    first = np.cumsum([0, *map(len, texts)])
    tables = []
    for _ in range(R.ROUNDS):
        _, names, text = R.rounds(words, first, 13, tables, True)
        owners = defaultdict(set)
        for n, t in zip(names.tolist(), text.tolist()):
            owners[n].add(t)
        tables.append(Names([n for n, o in owners.items() if len(o) > 1]))
    dead = R.rounds(words, first, 13, tables, False)[0]
    seen = defaultdict(set)
    places = [(t, k) for t, w in enumerate(texts) for k in range(len(w) - 12)]
    for t, k in places:
        seen[tuple(texts[t][k : k + 13])].add(t)
    repeated = [(t, k) for t, k in places if len(seen[tuple(texts[t][k : k + 13])]) > 1]
    assert len(repeated) >= 60 and not any(dead[first[t] + k] for t, k in repeated)
    assert sum(dead[first[t] + k] for t, k in places) > 0.7 * (len(places) - len(repeated))


def test_op7_brute_force(spark, docs, sf_dir):
    odd_items = [(900, "one two three"), (901, PASSAGE), (901, PASSAGE), (902, ""), (903, None), (None, "spam spam"), (904, "日本語 テキスト")]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(odd_items, "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for r in bench.collect():
        w = word((r.text or "").translate(LOWER))
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w and r.item_id is not None else 0):
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    sizes, expected = {len(x) for x in windows}, []
    for i, t in texts(docs):
        w, hit, items = word((t or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit.update(range(k, k + n))
        expected.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontaminate.contamination(docs, bench), columns, expected)
    same(decontaminate.contamination(docs, bench, broadcast_words=0), columns, expected)  # all joins shuffled


def test_op8_base_scores(docs):
    rows = [(i, [*WORD((t or "").translate(LOWER)), None]) for i, t in texts(docs)]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    out = defaultdict(list)
    for r in kneser_ney.lm_scores(docs).collect():
        out[r.doc_id].append(r)
    for i, ws in rows:
        r = out[i].pop(next(k for k, x in enumerate(out[i]) if x.n_tokens == len(ws)))
        assert (r.held_out, r.n_known, r.train_tokens) == (held[i], sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_op8_predicts_better_than_base(real):
    rows = kneser_ney.lm_scores(real).filter("held_out").selectExpr("sum(score) AS model", "sum(base_score) AS base").first()
    assert rows.model > rows.base


def test_op9_main_text(spark):
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>A &amp; b   c,\n" + "long words of the text. " * 20 + "</p><div class='comments'><p>nice post</p></div></article><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut <b")], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[1].text == "Title A & b c, " + " ".join(["long words of the text."] * 20) and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text) == ("", "", "cut")


def test_op10_brute_force(docs):
    sets, rows = {}, texts(docs)
    for i, t in rows:
        w = WORD((t or "").translate(LOWER))
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for (i, _), s in sets.items() if i is not None and s]
    for a, x in known:
        for b, y in known:
            if a < b and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    expected = [(i, len(sets[i, t]), None if i is None else root(i), i is None or root(i) == i) for i, t in rows]
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    same(minhash.near_duplicates(docs), columns, expected)
    same(minhash.near_duplicates(docs, block=1), columns, expected)  # every bucket is a star, mixed ones are joined by prefixes


def test_op10_hot_bands(spark):
    """Three texts whose variants share bands by the hundred, and unlike texts beside them."""
    import random

    rng = random.Random(1)
    rows, groups = [], []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(300)]
        groups.append([])
        for v in range(150):
            words = list(base)
            words[rng.randrange(300)] = f"x{g}y{v}"
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(f"r{rng.randrange(10**6)}" for _ in range(80))) for k in range(100)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all({out[k] for k in g} == {g[0]} for g in groups) and all(out[k] == k for k in range(450, 550))


def test_op10_recall(real):
    """Links found by one pass over the bands against all pairs with enough in common."""
    sets = {}
    for i, t in texts(real):
        w = WORD((t or "").translate(LOWER))
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    linked = {a for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    out = minhash.near_duplicates(real).groupBy("component_id").agg({"doc_id": "collect_list"}).collect()
    ours = {i for r in out if len(r[1]) > 1 for i in r[1]}
    assert linked and len(linked & ours) >= 0.9 * len(linked) and ours <= linked


def test_empty_tables(spark, odd, sf_dir):
    import public_tokenizers

    none, labels, bench = odd.limit(0), spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        quality.quality_rules(none, labels), sentencepiece_bpe.encode(none, public_tokenizers.path("piece_bpe_32k.model")), language.language_of_documents(none), suffix_array.remove_repeats(none), recompression.remove_repeats(none),
        decontaminate.contamination(none, bench), kneser_ney.lm_scores(none), minhash.near_duplicates(none), html_text.extract(pages), warc.archive_round_trip(pages),
    ):
        assert df.count() == 0
    assert quality.quality_rules(odd, labels.limit(0)).count() == len(ODD)
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    import oracle

    _, differs = oracle.compare(registry.queries()[name](spark, sf_dir), oracle.connect(sf_dir), registry.oracle_sql()[name])
    assert not differs


def test_op7_repeated_words_and_long_copies(spark):
    """Places of one fingerprint on both sides do not multiply, and an item of any length is found."""
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, "spam " * 3000), (2, "start " + long + " end"), (3, "ham " * 20), (4, "x " * 9 + "spam " * 12)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "spam " * 1500), (2, long), (3, "ham " * 5), (4, "never " * 30)], "item_id long, text string")
    sha_of = lambda *items: sha(",".join(items))
    expected = [(1, 3000, 3000, 1, sha_of("1"), True), (2, 20_002, 20_000, 1, sha_of("2"), True), (3, 20, 20, 1, sha_of("3"), True), (4, 21, 12, 1, sha_of("1"), True)]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontaminate.contamination(docs, bench), columns, expected)
    same(decontaminate.contamination(docs, bench, broadcast_words=0), columns, expected)
