"""The operators against brute force, round trips and held-out rows, with odd rows among them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarterbook.llm import packing, queries, substring_dedup
from quarterbook.llm._common import read_table
from quarterbook.llm.jaccard_join import joining_links, ordered, shingles, similar_components
from quarterbook.llm.kd_sharding import kd_shards
from quarterbook.llm.language_id import identify
from quarterbook.llm.oracles import ORACLES
from quarterbook.llm.quality import isotonic, score_quality
from quarterbook.llm.secret_scan import RULES, found_spans, redact_secrets, scan_secrets, trigram_query
from quarterbook.llm.sentence_pieces import codec, encode_decode
from quarterbook.llm.substring_dedup import remove_passages, repeated_passages
from quarterbook.llm.telephony import STEPS, TABLES, adpcm_blocks, decode_audio, features, read_wav, resampled, store_audio, wav
from quarterbook.llm.voronoi_knn import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _id string, score string, shard string"


def rows_of(spark, sf_dir):
    """Documents of the test data, and odd ones: nulls, empty and blank texts, a long one, near copies, ties, repeated rows."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in read_table(spark, sf_dir, "documents").collect()]
    base = docs[0][1]
    words = base.split(" ")
    odd = [None, "", " \n\t ", "one two", "One two", "a b c d e", "x " * 3000, base, base.replace(words[3], "changed", 1), base + " tail words", words[5] + " " + base, "äö \U0001f642 " * 20, "12 34 ,,, ...", "password=abcdef1 AKIA" + "B" * 16 + " " + "a1" * 14 + " token: 'abc'"]
    docs += [(100_000 + i, t, None if i % 3 else "en", None if i % 2 else "src0", None) for i, t in enumerate(odd)]
    docs += [docs[1], docs[1], (None, base, "en", "src0", 1), (None, None, None, None, None)]
    return docs


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return rows_of(spark, sf_dir)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup_is_brute_force(docs, rows, none):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {x for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for hot in (20_000, 1):
        substring_dedup.HOT = hot
        got = Counter(tuple(r) for r in repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == want
    substring_dedup.HOT = 20_000
    assert sum(n for _, _, n, _ in want) > 500
    assert repeated_passages(none).count() == 0


def test_passages_leave_the_text(docs, rows):
    spans = {(r.doc_id, r._text_hash): r for r in repeated_passages(docs).collect()}
    assert len(spans) >= len({(i, t) for i, t, *_ in rows}) - 2
    left = remove_passages(docs, 13)
    assert left.columns == docs.columns
    whole = Counter(WORD.findall(" ".join(t or "" for _, t, *_ in rows)))
    kept = Counter(WORD.findall(" ".join(r.text or "" for r in left.collect())))
    removed = sum(r.n_removed for r in repeated_passages(docs).collect())
    assert sum(whole.values()) - sum(kept.values()) == removed
    assert not kept - whole


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [x.encode().lower() for x in WORD.findall(t or "")]
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets.setdefault(i, s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(s), root(i) if i is not None else None) for i, s in sets.items() if i is not None}


def near_copies(n, seed, swap):
    rnd = np.random.default_rng(seed)
    base = [f"w{k}" for k in rnd.integers(0, 10**6, 120)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rnd.integers(0, 120, int(rnd.integers(0, swap))):
            own[at] = f"v{rnd.integers(0, 10**6)}"
        out.append((i, " ".join(own)))
    return out


def test_jaccard_join_is_brute_force(spark, docs, rows, none):
    got = {tuple(r) for r in similar_components(docs).collect() if r.doc_id is not None}
    assert got == brute_components(rows)
    assert similar_components(none).count() == 0


@pytest.mark.parametrize("swap", [4, 9])
def test_jaccard_join_of_many_near_copies(spark, swap, monkeypatch):
    from quarterbook.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PAIRED", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = near_copies(90, swap, swap) + [(1000 + i, t + " and more of it") for i, t in near_copies(40, 77, 6)] + [(2000, None)]
    table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert {tuple(r) for r in similar_components(table).collect()} == brute_components(rows)


def test_trie_finds_all_components():
    common = np.zeros(1 << 20, np.uint8)
    for seed in range(6):
        texts = [t for _, t in near_copies(25, seed, 8)] + [t for _, t in near_copies(25, seed + 50, 8)]
        sets = [shingles(t) for t in texts]
        got = joining_links([ordered(s, common) for s in sets])
        parent = list(range(len(sets)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in got:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
            parent[root(a)] = root(b)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    assert root(a) == root(b)


def test_secrets_equal_a_plain_scan(docs, rows):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want[i, ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))] += 1
    base = {"assign", "access", "hex"}
    got = Counter((r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind in base)) for r in scan_secrets(docs).collect())
    assert got == want and any(k[1] for k in want)


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") is True
    assert trigram_query("ab.cd") is True
    tri = lambda s: s[0] << 16 | s[1] << 8 | s[2]
    assert trigram_query("abcd") == ("and", (tri(b"abc"), tri(b"bcd")))
    assert set(trigram_query("abc|xyz")[1]) == {tri(b"abc"), tri(b"xyz")}
    assert trigram_query("(?:abc)+x*def") == ("and", (tri(b"abc"), tri(b"def")))
    assert trigram_query("a?bcd") is not True
    texts = ["apikey=abcdef", "API_KEY: 'abcdefg'", "ap1key=abcdef", "", "Secret=" + "z" * 9, "gh" + "p_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    plain = [{(r.kind, *m.span()) for r in RULES for m in re.finditer(r.pattern, t, re.A) if r.holds(m)} for t in texts]
    assert [set(x) for x in found_spans(texts)] == plain


def test_redaction_keeps_rows(docs):
    out = redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not any(r.spans for r in scan_secrets(out).collect() if r.doc_id == 100_013)


def test_audio_tables_and_blocks():
    assert TABLES["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rnd = np.random.default_rng(1)
    blocks = rnd.integers(0, 256, (40, 64), dtype=np.uint8)
    moves = [-1, -1, -1, -1, 2, 4, 6, 8]
    for block, got in zip(blocks, adpcm_blocks(blocks), strict=True):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(STEPS[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + moves[nibble & 7]))
                want.append(value)
        assert got.tolist() == want
    assert resampled(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    assert read_wav(wav(b"abcd" * 16, "adpcm"))[0::2] == ("adpcm", b"abcd" * 16)


def test_audio_round_trip(docs, rows, none):
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    got = features(decode_audio(store_audio(docs), keep=("n_bytes",))).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in got})
    for r in decode_audio(store_audio(docs)).collect():
        n = r.payload_bytes if r.codec != "adpcm" else r.payload_bytes // 64 * 121
        assert len(r.pcm) == 2 * 2 * n  # 16 bits, twice the rate
    assert decode_audio(store_audio(none)).count() == 0 and features(decode_audio(store_audio(none))).count() == 0


def check_packing(got, capacity):
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for held in slots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(slots)


def test_packing_is_whole_and_tight(docs, rows, none):
    from tokenizers import Tokenizer

    ranks, tokenizer = queries.tokenizer_path(queries.RANKS), Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = packing.best_fit_pack(docs, ranks, 256, 0).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids), 256)] if len(ids) > 256 else [0]
        for k, s in enumerate(cuts):
            want[i, k, s, tuple(ids[s : cuts[k + 1] if k + 1 < len(cuts) else None])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    total = sum(r.length for r in got)
    assert check_packing(got, 256) <= -(-total // 256) * 1.02 + 1
    digests = packing.best_fit_pack(docs, ranks, 256, 0, payload="crc32").collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in digests) == Counter((r.doc_id, r.piece, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    assert packing.best_fit_pack(none, ranks, 256, 0).count() == 0


def test_plan_is_best_fit_decreasing():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        lengths = sorted(rnd.integers(1, 65, int(rnd.integers(1, 400))).tolist(), reverse=True)
        rooms: list[int] = []
        for n in lengths:  # one document at a time
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((64 if fit is None else fit) - n)
        ranges = packing.plan(Counter(lengths), 64)
        taken = defaultdict(set)
        used = defaultdict(list)
        for length, a, b, each, first, offset in ranges:
            for k in range(a, b):
                assert k not in taken[length]
                taken[length].add(k)
                used[first + (k - a) // each].append((offset + (k - a) % each * length, length))
        assert {n: len(t) for n, t in taken.items()} == Counter(lengths)
        assert len(used) == len(rooms) and all(sum(x for _, x in u) <= 64 for u in used.values())


def test_top_k_is_brute_force(spark, none):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 8).round(2)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)] + [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, rows[0][1]), (700, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in top_k(table).collect()} == want
    assert top_k(table.limit(0)).count() == 0
    few = top_k(table.where("vec_id in (0, 3)")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 3)]


def test_top_k_oracle(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = set(duck.sql(ORACLES["op6_exact_top_k"]).fetchall())
    assert {tuple(r) for r in queries.op6_exact_top_k(spark, sf_dir).collect()} == want


def test_quality_on_held_out_rows(spark, sf_dir, none):
    big = sf_dir.replace("0.001", "0.01")
    labels = read_table(spark, big, "labels")
    scored = {r.doc_id: r for r in score_quality(read_table(spark, big, "documents"), labels).collect()}
    held = [(scored[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in scored and scored[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    odd = score_quality(read_table(spark, big, "documents"), labels.limit(0)).collect()
    assert {r.score for r in odd} == {0.5}
    assert score_quality(none, labels).count() == 0


def test_quality_of_odd_rows(docs, rows, spark, sf_dir):
    assert score_quality(docs, read_table(spark, sf_dir, "labels")).count() == len(rows)


def test_isotonic():
    at, value = isotonic(np.arange(4.0), np.array([0.0, 2, 1, 3]), np.array([1.0, 2, 2, 3]))
    assert value.tolist() == [0, 0.75, 1] and at.tolist() == [0, 1.5, 3]


def test_languages_of_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op8_language_id(spark, big).collect()}
    rows = read_table(spark, big, "documents").collect()
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out and re.search(r"[^\W\d_]", r.text or "")]
    assert np.mean(held) > 0.95


def test_languages_of_odd_rows(docs, rows, none):
    got = Counter((r.doc_id, r.lang_pred == "und") for r in identify(docs).collect())
    assert got == Counter((i, not re.search(r"[^\W\d_]", t or "")) for i, t, *_ in rows)
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false or lang is null")).collect()} == {"und"}
    assert identify(none).count() == 0


def test_shards_are_even_and_gapless(spark, docs, rows, sf_dir, none):
    big = sf_dir.replace("0.001", "0.1")
    got = kd_shards(read_table(spark, big, "documents"))
    sizes = got.groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 24 and sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98
    held = defaultdict(list)
    for r in kd_shards(docs).collect():
        held[r.shard].append(r.slot)
        assert 0 <= r.shard < 24
    assert sum(map(len, held.values())) == len(rows) and all(sorted(x) == list(range(len(x))) for x in held.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in kd_shards(docs).collect()) == want
    assert kd_shards(none).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")


def test_sentence_pieces_equal_the_library(docs, rows, none):
    model = queries.tokenizer_path(queries.PIECES)
    own = codec(model)
    rnd = np.random.default_rng(3)
    alphabet = list(" \n\t▁abceéßあ\U0001f642\x00<>s2") + ["  ", "the", "ing", " of"]
    for _ in range(800):
        text = "".join(rnd.choice(alphabet, int(rnd.integers(0, 30))))
        ids = np.frombuffer(own.encode([text])[0], np.uint32).tolist()
        assert ids == own.library.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == own.library.decode(ids)
    words = ["".join(rnd.choice(alphabet, int(rnd.integers(1, 40)))).replace(" ", "▁").replace("\n", "") or "a" for _ in range(500)]
    assert own.merged_together(words)[0].tolist() == [i for w in words for i in own.merged(w)]
    for _ in range(800):
        ids = [int(i) for i in rnd.integers(0, 32000, int(rnd.integers(0, 12))) if not 2 < i < 259]
        assert own.decode(ids) == own.library.decode(ids)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(docs, model).collect())
    assert got == Counter((i, tuple(own.library.encode(t or "", add_bos=True, add_eos=True)), own.library.decode(own.library.encode(t or ""))) for i, t, *_ in rows)
    assert encode_decode(none, model).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = read_table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < kept.count() <= docs.count()
    assert not [r for r in scan_secrets(kept).collect() if r.spans]
    assert p.run(spark, sf_dir).select("doc_id").distinct().count() == kept.count()
