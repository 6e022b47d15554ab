"""The registered queries themselves over a small folder of odd rows, each against a plain version, with the columns of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm_operators import WORD, brute_components, rows_of

from quarterbook.llm import collocations, decontamination, language_id, quality, queries
from quarterbook.llm._common import read_table
from quarterbook.llm.periodic_runs import periodic_runs, runs_of
from quarterbook.llm.secret_scan import RULES
from quarterbook.llm.telephony import CODECS, STEPS

LONG = " ".join(f"word{k * k % 9973} {'x' * (k % 11)}" for k in range(330_000))  # about 4 MB
SECRETS = "secret: abcdefg1, API_KEY='ZZZZZZ99'\npasswd=x token = short1 AKIA" + "Q7" * 9 + " äö \U0001f642 Token:tttttttt " + "0a" * 20


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [*rows_of(spark, sf_dir), (300_000, LONG, "en", "src0", len(LONG)), (300_001, "tail of it " + LONG[2_000_000:], "en", "src0", 1), (300_002, SECRETS, "en", "src0", 1)]


@pytest.fixture(scope="module")
def folder(rows, sf_dir, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    clash = {n: pa.array(["clash"] * len(rows)) for n in ("_id", "_text", "_text_hash", "spans", "score", "shard", "slot", "codec", "piece", "token", "_key", "digest", "row", "items", "runs", "best", "collapsed", "h", "lang_", "_lang", "phrase", "word", "n")}
    pq.write_table(pa.table(dict(zip(names, columns, strict=True)) | clash), where / "documents.parquet", row_group_size=50)
    pq.write_table(pq.read_table(f"{sf_dir}/labels.parquet"), where / "labels.parquet")
    words = [w for w in rows[0][1].split() if w.isalpha()]
    items = [("1", " ".join(rows[0][1].split()[5:40])), ("2", "one two"), ("3", None), ("4", " ,; "), (None, " ".join(rows[3][1].split()[:12])), ("2", "a b, C d; e"), ("10", rows[0][1].upper()), ("5", words[0]), ("6", LONG), ("7", "never said anywhere " * 9)]
    columns = {"item_id": pa.array([i for i, _ in items], pa.string()), "text": pa.array([t for _, t in items], pa.string())}
    pq.write_table(pa.table(columns | {n: pa.array(["clash"] * len(items)) for n in ("item", "words", "row", "_text")}), where / "benchmark.parquet")
    rnd = np.random.default_rng(8)
    vectors = [(i, rnd.normal(0, 1, 8).round(2).tolist()) for i in range(320)] + [(330, None), (350, [None] * 8), (400, [float("nan")] * 8), (None, [0.0] * 8), (7, [1.0] * 8), (50, [0.5] * 8)]
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())), "score": pa.array([1] * len(vectors)), "cell": pa.array(["x"] * len(vectors))}), where / "embeddings.parquet")
    return str(where)


def test_op1(spark, folder, rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - 12):
                key = hash(tuple(w[k : k + 13]))
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        for k in range(len(w) - 12):
            if i is not None and first[hash(tuple(w[k : k + 13]))] < i:
                gone[k : k + 13] = b"\1" * 13
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    got = queries.op1_substring_dedup(spark, folder)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def test_op2(spark, folder, rows):
    patterns = {
        "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    order = [r.kind for r in RULES]
    spell = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], order.index(x[1]))))
    want = Counter()
    for i, t, *_ in rows:
        base = {k: [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if holds(m)] for k, (p, holds) in patterns.items()}
        more = [(m.start(), r.kind, m.end()) for r in RULES[3:] for m in re.finditer(r.pattern, t or "", re.A)]
        own = [s for found in base.values() for s in found]
        want[i, *(len(base[k]) for k in patterns), hashlib.sha256(spell(own).encode()).hexdigest(), spell(own + more)] += 1
    got = queries.op2_secret_scans(spark, folder)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert Counter(tuple(r) for r in got.collect()) == want and sum(n for _, n, *_ in want) > 3


def test_op2_in_slices_of_very_many_texts():
    from quarterbook.llm._common import slices
    from quarterbook.llm.secret_scan import found_spans

    texts = [""] * ((1 << 20) + 1) + ["password=abcdef1"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(slices(iter([batch]), "text"))
    assert max(p.num_rows for p in parts) <= 1 << 16 and sum(p.num_rows for p in parts) == len(texts)
    assert found_spans(parts[-1].column("text").to_pylist())[-1] == [("assign", 0, 16)]


def decoded(codec, payload):
    """One sample at a time."""
    out = []
    if codec == "adpcm":
        moves = [-1, -1, -1, -1, 2, 4, 6, 8]
        for at in range(0, len(payload), 64):
            block = payload[at : at + 64]
            value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            out.append(value)
            for byte in block[4:]:
                for nibble in (byte & 15, byte >> 4):
                    step = int(STEPS[index])
                    change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                    value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                    index = max(0, min(88, index + moves[nibble & 7]))
                    out.append(value)
        return out
    for byte in payload:
        if codec == "mulaw":
            c = ~byte & 255
            size = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
            out.append(-size if c & 128 else size)
        else:
            c = byte ^ 0x55
            part, low = (c >> 4) & 7, (c & 15) << 4
            size = low + 8 if part == 0 else (low + 264) << (part - 1)
            out.append(size if c & 128 else -size)
    return out


def test_op3(spark, folder, rows):
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        codec = CODECS[zlib.crc32(full) % 3]
        feature = None
        if len(full) < 20_000:
            x = decoded(codec, full)
            twice = [y for a, b in zip(x, [*x[1:], x[-1]], strict=True) for y in (a, a + ((b - a) // 2 if b != a else 0))]
            pcm = np.array(twice, "<i2")
            turns = sum((a < 0) != (b < 0) for a, b in zip(twice, twice[1:], strict=False))
            feature = f"{codec} samples={len(twice)} peak={max(map(abs, twice))} energy={sum(a * a for a in twice) // len(twice)} turns={turns} pcm_crc32={zlib.crc32(pcm.tobytes())}"
        head = 60 if codec == "adpcm" else 58
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(full) + head, feature] += 1
    got = queries.op3_telephony_audio(spark, folder)
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    found = got.collect()
    assert Counter((*tuple(r)[:6], r.feature if r.payload_bytes < 20_000 else None) for r in found) == want
    assert len({r.payload_sha256 for r in found}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in found})


def test_op4(spark, folder, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)] if len(ids) > 2048 else [0]
        for k, s in enumerate(cuts):
            own = ids[s : cuts[k + 1] if k + 1 < len(cuts) else None]
            want[i, k, s, len(own), zlib.crc32(own.tobytes())] += 1
    got = queries.op4_best_fit_packing(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = got.collect()
    assert Counter(tuple(r)[:5] for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.sequence_id].append((r.offset, r.length))
    for held in slots.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(slots) <= -(-total // 2048) * 1.02 + 1


def test_op5(spark, folder, rows):
    got = queries.op5_ngram_jaccard_join(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {tuple(r) for r in got.collect() if r.doc_id is not None} == brute_components(rows)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, *_ in rows)


def test_op6(spark, folder):
    held = [(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist())) for i, v in zip(*pq.read_table(f"{folder}/embeddings.parquet").select(["vec_id", "embedding"]).to_pydict().values(), strict=True) if i is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q in {i for i, _ in held if i % 50 == 0}:
        asks = min(v for i, v in held if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v, strict=True)), i) for i, v in held if i != q)[:5]
        want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    got = queries.op6_exact_top_k(spark, folder)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and Counter(tuple(r) for r in got.collect()) == want


def test_op7_is_its_sums_in_numpy(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text or "") for r in read_table(spark, big, "documents").select("doc_id", "text").collect()]
    label = {r.doc_id: r.quality for r in read_table(spark, big, "labels").collect() if r.quality is not None}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    x = quality.statistics_of([t for _, t in docs])
    y = np.array([label.get(i, -1) for i, _ in docs], float)
    folds = np.array([fold(i) for i, _ in docs])
    fits, calibrates = (y >= 0) & (folds < 2), (y >= 0) & (folds == 3)
    model = quality.Model(x[fits].mean(0), np.where(x[fits].std(0) > 0, x[fits].std(0), 1), np.zeros(quality.FOURIER + 1))
    z = model.features(x[fits])
    model.weights = np.linalg.solve(z.T @ z + 1e-3 * fits.sum() * np.eye(z.shape[1]), z.T @ y[fits])
    raw = model.raw(x[calibrates])
    bins = np.clip((raw + 0.5) * quality.BINS / 2, 0, quality.BINS - 1).astype(int)
    at = [(raw[bins == b].mean(), y[calibrates][bins == b].sum(), (bins == b).sum()) for b in np.unique(bins)]
    model.knots, model.values = quality.isotonic(*(np.array(c, float) for c in zip(*at, strict=True)))
    want = np.clip(model.scores(x), 0, 1)
    got = queries.op7_quality_classifier(spark, big)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    scored = {r.doc_id: r for r in got.collect()}
    assert len(scored) == len(docs)
    assert np.mean(np.abs(np.array([scored[i].score for i, _ in docs]) - want) < 1e-3) > 0.99
    again = {r.doc_id: r.score for r in quality.score_quality(read_table(spark, big, "documents").repartition(7), read_table(spark, big, "labels").repartition(3)).collect()}
    assert np.mean([abs(again[i] - scored[i].score) < 1e-6 for i in scored]) > 0.999


def test_op7_of_odd_rows(spark, folder, rows):
    got = queries.op7_quality_classifier(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)


def test_op8_is_its_counts_in_numpy(spark, folder, rows):
    held_out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    width = 1 << language_id.BITS
    counts, seen = defaultdict(lambda: np.zeros(width + 1)), Counter()
    for i, t, lang, *_ in rows:
        if lang is not None and not held_out(i):
            seen[lang] += 1
            for code in language_id.codes_of([t or ""])[0]:
                np.add.at(counts[lang], code, 1)
    names = sorted(seen)
    prob = np.stack([np.append(np.log((counts[n][:-1] + 0.5) / (counts[n][:-1].sum() + 0.5 * width)), 0) for n in names])
    prior = np.log(np.array([seen[n] for n in names]) / sum(seen.values()))
    want = Counter()
    for i, t, *_ in rows:
        total = prior + sum(prob[:, code].sum(1) for code in language_id.codes_of([t or ""])[0])
        letters = any(c.isalpha() for c in t or "")
        want[i, held_out(i), names[int(total.argmax())] if letters else "und"] += 1
    got = queries.op8_language_id(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert Counter(tuple(r)[:3] for r in got.collect()) == want and all(0 <= r.score <= 1 for r in got.collect())


def test_op9(spark, folder, rows):
    got = queries.op9_kd_sharding(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes") for i, t, *_ in rows)
    assert {r.grown_shard for r in found} == {None} and all(0 <= r.shard < 24 for r in found)
    held = defaultdict(list)
    for r in found:
        held[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in held.values())


def test_op9_parts_repeated_rows(spark):
    from quarterbook.llm.kd_sharding import kd_shards

    rows = spark.range(0, 4000, 1, 4).selectExpr("7L as doc_id", "'the same text in every row of the table' as text", "'en' as lang", "'s' as source")
    sizes = [r["count"] for r in kd_shards(rows).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 1.3 * min(sizes) and sum(sizes) == 4000


def test_op10(spark, folder, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = queries.op10_sentencepiece(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(tuple(r) for r in got.collect()) == want


def plain_runs(words, most=None):
    """The smallest period of each longest stretch (start, end) of four periods and six words, of periods up to `most`."""
    number, out, n = {}, {}, len(words)
    s = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, min(n // 4, most or n) + 1):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], (s[:-q] == s[q:]).astype(np.int8), [0]])))
        for a, b in turns.reshape(-1, 2).tolist():
            if b + q - a >= max(6, 4 * q):
                out.setdefault((a, b + q), q)
    return out


def test_op11(spark, folder, rows):
    want, long = Counter(), {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and w:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 100_000:
            long[i] = plain_runs(w, 200)
            continue
        found = plain_runs(w)
        best = min(found.items(), key=lambda r: (-Fraction(r[0][1] - r[0][0], r[1]), r[0][0], r[1])) if found else None
        gone = {x for (a, b), q in found.items() for x in range(a + q, b)}
        listed = "".join(f"{a},{b - a},{q}\n" for (a, b), q in sorted(found.items(), key=lambda r: (r[0][0], r[1])))
        told = (best[0][0], best[0][1] - best[0][0], best[1], 1000 * (best[0][1] - best[0][0]) // best[1]) if best else (None,) * 4
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(found), *told, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))] += 1
    got = queries.op11_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect() if r.doc_id not in long) == want and len(long) == 2
    assert sum(n > 0 for _, n, *_ in want) > 5 and max(n for _, n, *_ in want) > 1
    every = {r._id: r for r in periodic_runs(queries.with_periods(read_table(spark, folder, "documents").where("doc_id >= 300000")).withColumnRenamed("doc_id", "_id"), id_col="_id").collect()}
    for i, found in long.items():
        assert {(r.start, r.start + r.length): r.period for r in every[i].runs if r.period <= 200} == found


def test_op11_of_many_small_alphabets():
    rnd = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for _ in range(5):
            n, letters = int(rnd.choice([0, 5, 7, 40, 130])), int(rnd.choice([1, 2, 3, 9]))
            w = rnd.integers(0, letters, n).tolist()
            if n and rnd.random() < 0.6:
                a = int(rnd.integers(0, n))
                p = 1 + (n - a) // int(rnd.integers(3, 11))
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            texts.append(w)
        got = runs_of(np.array(sum(texts, []), np.int32), np.array([len(w) for w in texts]))
        assert got == [plain_runs(w) for w in texts]
    nested = np.array(([0] * 999 + [1]) * 30 + list(range(5000)), np.int32)
    assert runs_of(nested, np.array([len(nested)])) == [plain_runs(nested.tolist())]


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_phrases(rows, least=10, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in (1, 2, 3):
                counts[lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = set()
    for lang, f in counts.items():
        found, inside = [], Counter()
        for phrase, a in f.items():
            if len(phrase) == 3 and a >= least:
                for part in (phrase[:2], phrase[1:]):
                    inside[part] = max(inside[part], a)
        for phrase, a in f.items():
            if len(phrase) > 1 and a >= least and not (len(phrase) == 2 and 100 * inside[phrase] >= 50 * a and inside[phrase]):
                score, _, l, r = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
                found.append((-score, -a, " ".join(phrase).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)}
    return out


def test_op12(spark, folder, rows):
    got = queries.op12_collocations(spark, folder)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_phrases(rows) and len(found) > 100


def test_op12_in_small_buckets_and_parts(spark, sf_dir, monkeypatch):
    """Pivots in several buckets, buckets mined in parts, fewer phrases asked for, words that share counters."""
    rows = [(r.doc_id, r.text, r.lang) for r in read_table(spark, sf_dir, "documents").collect()] + [(1, "x y x. Y! z\tz z z z", None), (1, "q Q q q q q", None)] * 12
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 500)
    monkeypatch.setattr(collocations, "MINED_ROWS", 40)
    monkeypatch.setattr(collocations, "SLICE", 1 << 14)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in collocations.collocations(table, most=50).collect()} == plain_phrases(rows, most=50)
    assert {tuple(r) for r in collocations.collocations(table, least=3).collect()} == plain_phrases(rows, 3)


def test_op12_scores_beyond_64_bits(spark):
    counts = [("x", None, -1, 9), ("x", "a", 1, 4_000_000_000_000), ("x", "b", 2, 3_000_000_000_001)]
    score = lambda a, l, r: 1_000_000 * a * a // (l * r)
    spark_score = spark.sql("select (1000000BD * cast(cast(2999999999999 as decimal(19,0)) * cast(2999999999999 as decimal(19,0)) as decimal(31,0))) div (cast(4000000000000 as decimal(19,0)) * cast(3000000000001 as decimal(19,0))) as s").first().s
    assert spark_score == score(2_999_999_999_999, counts[1][3], counts[2][3])


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(texts, items, window=10):
    """For each text: number of words, those hit, items."""
    words = lambda t: NORMAL.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[own]
        out.append((len(w), hit, named))
    return out


def test_op13(spark, folder, rows):
    items = list(zip(*pq.read_table(f"{folder}/benchmark.parquet").select(["item_id", "text"]).to_pydict().values(), strict=True))
    want = Counter()
    for (i, *_), (n, hit, named) in zip(rows, plain_hits([r[1] for r in rows], items), strict=True):
        want[i, n, len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    got = queries.op13_decontamination(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in got.collect()) == want and len({x[4] for x in want}) > 3


def test_op13_in_many_blocks_and_parts(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    said = lambda n, letters: " ".join(f"w{k}" for k in rnd.integers(0, letters, n))
    items = [(k, said(int(rnd.integers(0, 60)), 3)) for k in range(30)]
    texts = [said(int(rnd.integers(0, 90)), 4) for _ in range(30)] + [items[3][1] * 3]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 70)
    monkeypatch.setattr(decontamination, "PART_WORDS", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for window in (1, 4, 10):
        got = {r.doc_id: (r.n_words, {x for s in r.spans for x in range(s.start, s.end)}, set(r["items"])) for r in decontamination.contamination(docs, bench, window).collect()}
        assert [got[i] for i in range(len(texts))] == plain_hits(texts, items, window)


def test_stretches_are_removed(spark):
    bench = spark.createDataFrame([("a", " ".join(f"b{k}" for k in range(12)))], "item_id string, text string")
    leak = "; ".join(f"B{k}" for k in range(12))
    texts = [f"é one, {leak}! two", f"{leak} {leak}", "clean, Text.", None, "", f"x {leak}"]
    docs = spark.createDataFrame([(k, t, 0 if t is None else len(t), "kept") for k, t in enumerate(texts)], "doc_id long, text string, n_chars int, row string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontamination.decontaminated(docs, bench, most_covered=0.9).collect()}
    assert got == {0: ("é one, two", 10), 2: ("clean, Text.", 12), 3: (None, 0), 4: ("", 0)}
    # 12 of 13 words are hit: more than 90 %, not more than 95 %
    assert {r.doc_id: r.text for r in decontamination.decontaminated(docs, bench, most_covered=0.95).collect()}[5] == "x "
    assert decontamination.decontaminated(docs, bench.limit(0)).columns == docs.columns
    assert {(r.doc_id, r.text) for r in decontamination.decontaminated(docs, bench.limit(0)).collect()} == set(enumerate(texts))


def test_empty_tables(spark, folder, sf_dir, tmp_path):
    for name in ("documents", "labels", "embeddings", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
