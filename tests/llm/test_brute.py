"""Operators whose results SQL cannot express, against plain Python: the classifier's updates and scores, licence scans, and the pipeline's stages one by one on odd rows."""

import math
import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from inkstone.llm import license_scan, packing, quality

from ..conftest import SMALL

FULL = (1 << 64) - 1


def spread(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def word_hash(word):
    if len(word) > 128:
        return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    parts = [int.from_bytes(word[i : i + 8], "little") for i in range(0, len(word), 8)]
    h = spread((parts[0] + len(word) * 0xC2B2AE3D27D4EB4F) & FULL)
    for part in parts[1:]:
        h = spread((h * 0x9E3779B97F4A7C15 + part) & FULL)
    return h


def pair_hash(a, b):
    x = (a * 0x9E3779B97F4A7C15 + b) & FULL
    return spread(((x ^ x >> 29) * 0xC2B2AE3D27D4EB4F + 2) & FULL)


def items(text):
    """Buckets of words and marks, of neighbours, and of words that come again at once or after another one."""
    low = (text or "").encode().lower()
    h = [word_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", low)]
    found = h + [pair_hash(a, b) for a, b in zip(h, h[1:])]
    found += [quality.REPEATS[gap] for gap in (1, 2) for a, b in zip(h, h[gap:]) if a == b]
    return Counter(x >> 64 - quality.BITS for x in found), len(found)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


class Learner:
    """Follow the regularised leader, a number at a time, over dictionaries."""

    def __init__(self):
        self.z, self.n = Counter(), Counter()

    def weight(self, k):
        z = self.z[k]
        return 0.0 if abs(z) <= quality.L1 else -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(self.n[k])) / quality.ALPHA + quality.L2)

    def learn(self, x, label):
        w = {k: self.weight(k) for k in x}
        error = sigmoid(sum(w[k] * v for k, v in x.items())) - label
        for k, v in x.items():
            g = error * v
            self.z[k] += g - (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / quality.ALPHA * w[k]
            self.n[k] += g * g


def plain_score(text, weights):
    counts, n = items(text)
    return sigmoid(sum(weights[k] * c for k, c in counts.items()) / math.sqrt(max(1, n)) + weights[-1])


def test_classifier_against_plain_updates(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 80").withColumn("text", F.substring("text", 1, 900))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    weights = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = labels.filter(F.col("quality").isNotNull() & ~quality.held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id", F.lit(7))).orderBy("turn").collect()
    own, bias = Learner(), 1 << quality.BITS
    examples = []
    for r in known:
        if r["doc_id"] in texts:
            counts, n = items(texts[r["doc_id"]])
            examples.append(({k: float(np.float32(c / math.sqrt(max(1, n)))) for k, c in counts.items()} | {bias: 1.0}, r["quality"]))
    assert len(examples) > 10 and len({y for _, y in examples}) == 2
    for _ in range(quality.EPOCHS):
        for x, y in examples:
            own.learn(x, y)
    want = np.zeros(bias + 1)
    for k in own.z:
        want[k] = own.weight(k)
    assert np.abs(weights - want).max() < 1e-5 and np.count_nonzero(want) > 100
    texts = [*texts.values(), None, "", " \n", "a a a b a b", "Straße ÉÉ 😀 !!! ... x", "w" * 300 + " x"]
    got = quality.scores([t and t.encode() for t in texts], weights)
    assert got.tolist() == [pytest.approx(plain_score(t, weights), abs=1e-6) for t in texts]


def plain_scan(files):
    """The licence, score, origin and directory of each (path, text), by plain vectors."""
    idf, units, unknown = license_scan.vectors(license_scan.TEMPLATES, license_scan.FULL)
    mark = license_scan.MARK
    own = []
    for path, text in files:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        parted = re.sub(rf"(?m)(^{mark}[^\n]*\n)(?!{mark}|$)", r"\1\n", low)
        parted = re.sub(rf"(?m)(^(?!{mark})[^\n]+\n)(?={mark})", r"\1\n", parted)
        parts = [(-1, low), *enumerate(low.split("\n")), *((-2 - i, p) for i, p in enumerate(re.split(r"\n(?:[^a-z0-9\n]*\n)+", parted)) if "\n" in p)]
        named = bool(path is not None and re.search(license_scan.NAMES, path))
        found = []
        for no, part in parts if re.search(license_scan.NOTICE, text or "") else ():
            if not re.search(license_scan.NOTICE, part):
                continue
            tf = Counter(license_scan.terms(part))
            norm = math.sqrt(sum((n * idf.get(t, unknown)) ** 2 for t, n in tf.items()))
            scores = [(round(sum(n * idf[t] * unit[t] for t, n in tf.items() if t in unit) / norm, 6), name, k) for name, k, unit in units] if norm else []
            best = max((s for s, _, _ in scores), default=0)
            if best >= license_scan.THRESHOLD:
                same = [(name, k) for s, name, k in scores if s == best]
                whole = no == -1
                full = any(k >= license_scan.FIRST_FULL for _, k in same)
                found.append((not (whole and full), -best, (whole if not named else not whole), no < -1, min(name for name, _ in same), abs(no), whole))
        file = any(f[-1] for f in found)
        own.append((min(found) if found else None, named or file))
    given = {}
    for (path, _), (best, file) in zip(files, own, strict=True):
        if best and file and path is not None:
            folder = path.rpartition("/")[0]
            given[folder] = min(given.get(folder, (9, "")), (best[1], best[4]))
    out = []
    for (path, _), (best, _) in zip(files, own, strict=True):
        if best:
            out.append((best[4], -best[1], "file" if best[-1] else "header", None))
            continue
        folder = path.rpartition("/")[0] if path is not None else None
        while folder is not None and folder not in given and folder:
            folder = folder.rpartition("/")[0]
        out.append((given[folder][1], -given[folder][0], "inherited", folder) if folder in given else (None, None, None, None))
    return out


def wrapped(text, mark, width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += word + " "
    return "\n".join(mark + x.rstrip() for x in [*lines, line])


def test_licences_against_a_plain_scan(spark):
    code = "\n".join(f"value_{i} = compute(other, {i})" for i in range(30))
    files = [("r/LICENSE", license_scan.FULL["MIT"][0]), ("r/a/x.py", code), ("r/a/b/c/y.py", None), (None, license_scan.TEMPLATES["CC-BY-4.0"][1]), ("top.txt", ""), ("q/COPYING", "nothing of note"), ("q/z.c", code)]
    for k, (name, texts) in enumerate(sorted((license_scan.TEMPLATES | license_scan.FULL).items())):
        for i, text in enumerate(texts):
            files.append((f"d{k}/{i}/plain.txt", f"{code}\n{text}\n{code}"))
            for j, m in enumerate(("# ", " * ", "// ", "")):
                files.append((f"d{k}/{i}/{j}/head.c", f"{'/*' if j == 1 else ''}\n{wrapped(text, m)}\n{'*/' if j == 1 else ''}\n{code}"))
            files.append((f"d{k}/{i}/LICENSE", wrapped(text, "", 70)))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("source", "doc_id", "text").limit(60).collect()
    files += [(f"t/{r['source']}/{r['doc_id']}", r["text"]) for r in docs]
    got = license_scan.scan(spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "no int, path string, text string")).orderBy("no").collect()
    want = plain_scan(files)
    for r, w, f in zip(got, want, files, strict=True):
        assert (r["license"], r["origin"], r["license_from"]) == (w[0], w[2], w[3]), f[0]
        assert r["score"] is None and w[1] is None or r["score"] == pytest.approx(w[1], abs=2e-6), f[0]
    assert sum(w[2] == "header" for w in want) > 100 and sum(w[2] == "inherited" for w in want) >= 2


LINE = "a line that is long enough to be one of those that many documents share"


@pytest.fixture(scope="module")
def odd(spark):
    words = [f"t{i}" for i in range(120)]
    rows = [(1, None, "b"), (2, "", "b"), (3, " \t\n ", None), (4, "one", "a"), (4, "one", "a"), (5, "one", "c"), (None, "no id here at all", "c"), (6, " ".join(f"v{i % 997}x{i}" for i in range(40_000)), "a"), (7, "é" * 90_000, "c")]
    rows += [(20 + i, f"own words number {i} of this document\n{LINE.upper() if i % 2 else '  ' + LINE}\nend {i}", "a") for i in range(8)]
    rows += [(40 + i, " ".join(words[: 120 - i] + [f"u{i}_{j}" for j in range(i)]), "bc"[i % 2]) for i in range(0, 20, 2)]
    rows += [(70 + i, " ".join(words[5:]), "d") for i in range(3)] + [(80, " ".join(words[5:]), "d")] * 4
    small = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()
    rows += [(1000 + r["doc_id"], r["text"], r["source"]) for r in small]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "kept", "key", "size", "node", "copies", "again", "target", "component_id", "n_lines", "predicted", "in_text", "dir")
    return df.withColumns({n: F.lit("x") for n in clash}).cache()


def table_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_stage_of_quality(spark, odd):
    weights = quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = pipeline.keep_quality(spark, odd, SMALL)
    assert got.columns == list(pipeline.COLUMNS)
    assert table_of(got) == [r for r in table_of(odd) if plain_score(r[1], weights) >= 0.5] and 0 < got.count() < odd.count()


def test_stage_of_lines(spark, odd):
    rows = table_of(odd)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    shared = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(ids) >= 5}
    assert shared
    want = [(i, "\n".join(line for line in (text or "").split("\n") if shared.get(key(line), i) == i), s) for i, text, s in rows]
    got = pipeline.drop_lines(spark, odd, SMALL)
    assert got.columns == list(pipeline.COLUMNS) and table_of(got) == sorted(want, key=str)
    assert got.filter(F.col("n_chars") != F.char_length("text")).count() == 0


def test_stage_of_near_texts(spark, odd):
    rows = [r for r in table_of(odd)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t or "")) else None for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i) if sets[i] else -1 - i, []).append(rows[i][0])
    got = pipeline.keep_one_of_near(spark, odd, SMALL)
    want = sorted((min((x for x in ids if x is not None), default=None) for ids in groups.values()), key=str)
    assert got.columns == list(pipeline.COLUMNS) and sorted((r["doc_id"] for r in got.collect()), key=str) == want and any(len(ids) > 5 for ids in groups.values())


def test_stage_of_mixing(spark, odd):
    got = pipeline.mix_sources(spark, odd, SMALL)
    assert got.columns == list(pipeline.COLUMNS)
    rows, taken = Counter(table_of(odd)), Counter(table_of(got))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for (_, t, s), n in rows.items():
        sizes[s] += n * size(t)
    from .test_mixing import by_place, water

    want = water(dict(sizes), by_place(sizes), 3.0)
    for s, target in want.items():
        base = min(3, int(target // sizes[s])) if sizes[s] else 0
        budget = min(sizes[s], round(target - base * sizes[s])) if base < 3 else 0
        sums = 1
        for (_, t, of), n in rows.items():
            for _ in range(n if of == s else 0):
                sums |= sums << size(t) & (1 << budget + 1) - 1
        assert sum(n * size(t) for (_, t, of), n in taken.items() if of == s) == base * sizes[s] + sums.bit_length() - 1, s
    assert all(k in rows and n <= 3 * rows[k] for k, n in taken.items())


def test_stage_of_packing(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = pipeline.pack(spark, odd, SMALL).collect()
    import zlib

    want = Counter()
    for i, t, _ in table_of(odd):
        want[i, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) if len(t or "") < 5000 else None] += 1
    lone = Counter((r["doc_id"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"])
    assert all(n <= want[k] for k, n in lone.items() if k in want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in table_of(odd))
    assert sum(r["length"] for r in got) == total


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_of_an_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SMALL).collect() == [], name
