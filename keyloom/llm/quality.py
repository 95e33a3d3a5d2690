"""Quality rules: word statistics, and bands of n-gram perplexity by language under a modified Kneser-Ney model.

The model's units are the characters themselves. Spark counts the n-grams of all documents, each language apart. A language
has two models, each from the half of its texts (by hash) that the other half is scored by, so no text, and no copy
of it, is scored by a model that has learnt it. A model's n-grams have no bound, so it is cut into parts of about PART_GRAMS n-grams
of ORDER units, by a hash of the two units before the last: all that shares a context of two or three units is in one part, and the orders
below, and counts of counts, are the whole language's. Parts lie in the shared folder; a worker holds HELD_BYTES of them.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import common as C

#: Code points below DIRECT are units as they are; each other one is a pair of units from SIDE leads and SIDE trails. So there are CLASSES
#: units, and ORDER of them fit in 63 bits.
DIRECT, SIDE = 0xCF00, 1031
ORDER, CLASSES = 4, DIRECT + 2 * SIDE
#: The order up to which a language's model is in one piece.
WHOLE = 2
SPACE = 32
#: Characters converted, and n-grams looked up, at once.
PIECE = 1 << 19
#: N-grams of a part of a model, about, and bytes of models that a worker holds (one model at least).
PART_GRAMS, HELD_BYTES = 1 << 21, 256 << 20
#: A document's log2 perplexity may lie so many spreads below and above its language's median. The spread joins that of the
#: language's documents (quartiles) with the chance spread of a text of so many units, RUN times as wide as for independent ones.
BAND = (2.5, 4.0)
RUN = 1.5
#: Perplexities are compared in steps of 1 / STEPS bit, so that quantiles and sums are exact and the same in each run.
STEPS = 4096
#: Bits that a language's spread has at least, so that a uniform corpus is not cut.
LEAST_SPREAD = 0.03
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def lower_table() -> np.ndarray:
    """The code point that stands for each: white space is one, a letter is its lower case where that is one code point, all others are themselves."""
    t = np.arange(0x110000, dtype=np.uint32)
    for k in range(0x20000):  # beyond, no letter has case
        low = chr(k).lower()
        if len(low) == 1:
            t[k] = ord(low)
    t[[9, 10, 11, 12, 13]] = SPACE
    return t


TABLE = lower_table()


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of the characters of all texts, each led by ORDER - 1 spaces and ended by one, runs of spaces folded, and
    where each text begins. Texts that differ in more than case and white space differ in units."""
    lead = " " * (ORDER - 1)
    strings = texts.to_pylist()
    n = np.array([len(s) + ORDER for s in strings], np.int64)
    flat = "".join([x for s in strings for x in (lead, s, " ")])
    pieces, pairs = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for at in range(0, len(flat), PIECE):
        points = TABLE[np.frombuffer(flat[at : at + PIECE].encode("utf-32-le"), np.uint32)]
        two = np.flatnonzero(points >= DIRECT)
        if len(two):
            rest = points[two] - DIRECT
            points = np.repeat(points, 1 + (points >= DIRECT))
            first = two + np.arange(len(two))
            points[first], points[first + 1] = DIRECT + rest // SIDE, DIRECT + SIDE + rest % SIDE
        pieces.append(points.astype(np.uint16))
        pairs.append(two + at)
    cls, bounds = np.concatenate(pieces), np.concatenate([[0], np.cumsum(n)])
    bounds += np.searchsorted(np.concatenate(pairs), bounds)  # a pair takes a place more
    starts = bounds[:-1]
    keep = cls != SPACE
    keep[1:] |= keep[:-1].copy()  # a space after another unit stays
    for k in range(ORDER - 1):
        keep[starts + k] = True
    keep[starts + ORDER - 1] = cls[starts + ORDER - 1] != SPACE  # the text follows spaces
    return cls[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, starts, dtype=np.int64) if len(n) else n)])


def grams(cls: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all n-grams of ORDER units, and the text of each, some at a time; the last unit of an n-gram is what is predicted."""
    owners = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for at in range(0, len(cls) - ORDER + 1, PIECE):
        n = min(PIECE, len(cls) - ORDER + 1 - at)
        code = cls[at : at + n].astype(np.int64)
        for k in range(1, ORDER):
            code *= CLASSES
            code += cls[at + k : at + k + n]
        ok = owners[at : at + n] == owners[at + ORDER - 1 : at + ORDER - 1 + n]
        yield code[ok], owners[at : at + n][ok]


def parts_of(codes: np.ndarray, many: int) -> np.ndarray:
    """The part of a model of many parts that each n-gram is in, by the units before the last that it shares with its lower orders."""
    return (C.mix((codes // CLASSES % CLASSES ** (ORDER - WHOLE)).astype(np.uint64), np.zeros(1, np.uint64)) % np.uint64(many)).astype(np.int32)


class KneserNey:
    """Interpolated modified Kneser-Ney estimates of one language: for each order the n-grams' codes in a sorted array, with
    their probabilities beside them; contexts' back-off weights likewise.

    From the counts of a language's n-grams of some order (continuation counts, below ORDER) come the orders up to it. Over a model of
    lower orders come those above it, from the counts of one part; the counts of counts (for each order from the top one downwards) are then
    given, as they are the language's.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int = ORDER, below: KneserNey | None = None, of_counts: np.ndarray | None = None, parts: int = 0) -> None:
        order = np.argsort(codes)
        codes, counts = codes[order].astype(np.int64), counts[order].astype(np.float64)
        self.below, self.least = below, 1 if below is None else below.least + len(below.levels)
        #: for a model of lower orders: the parts of those above, and their counts of counts
        self.parts, self.of_counts = parts, np.zeros((0, 4)) if of_counts is None else of_counts
        counted = [(codes, counts)]
        for k in range(top - 1, self.least - 1, -1):  # continuation counts: how many units stand before a shorter n-gram
            u, c = np.unique(counted[-1][0] % CLASSES**k, return_counts=True)
            counted.append((u, c.astype(np.float64)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.back: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (u, c) in zip(range(self.least, top + 1), reversed(counted), strict=True):
            d = self._discounts([(c == m).sum() for m in range(1, 5)] if below is None else self.of_counts[top - k])
            kind = np.minimum(c, 3).astype(int)
            ctx, inv = np.unique(u // CLASSES, return_inverse=True)
            total = np.bincount(inv, c)
            gamma = np.bincount(inv, d[kind]) / total
            lower = np.maximum(c - d[kind], 0) / total[inv] + gamma[inv] * self.prob(u)
            self.back.append((ctx, gamma))
            if k == 1:
                full = np.full(CLASSES, gamma[0] / CLASSES)
                full[u] = lower
                u, lower = np.arange(CLASSES), full
            self.levels.append((u, lower))

    @staticmethod
    def _discounts(of_counts) -> np.ndarray:
        n = [float(x) for x in of_counts]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        return np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] else 0.5 for k in (1, 2, 3)])

    @staticmethod
    def _find(sorted_: tuple[np.ndarray, np.ndarray], x: np.ndarray, missing: float) -> np.ndarray:
        u, v = sorted_
        if not len(u):
            return np.full(len(x), missing)
        k = np.minimum(np.searchsorted(u, x), len(u) - 1)
        return np.where(u[k] == x, v[k], missing)

    def prob(self, u: np.ndarray) -> np.ndarray:
        """Probability of the last unit of each n-gram, given the others, by the orders that are there."""
        p = np.full(len(u), 1.0 / CLASSES) if self.below is None else self.below.prob(u)
        for k, (level, back) in enumerate(zip(self.levels, self.back, strict=True), self.least):
            if k == 1:
                p = level[1][u % CLASSES]
            else:
                y = u % CLASSES**k
                p = np.maximum(self._find(level, y, 0.0), self._find(back, y // CLASSES, 1.0) * p)
        return p

    def log2(self, x: np.ndarray) -> np.ndarray:
        """log2 probability of the last unit of each n-gram, given the others."""
        u, inv = np.unique(x, return_inverse=True)
        return np.log2(self.prob(u))[inv]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for pair in (*self.levels, *self.back) for x in pair)


def model_file(where: str, lang: str, half: int, part: int | None = None) -> str:
    return f"{where}/{hashlib.md5(lang.encode()).hexdigest()}-{half}{'' if part is None else f'-{part}'}.npz"


def save_model(where: str, lang: str, half: int, model: KneserNey, part: int | None = None) -> None:
    """Written under another name first, so that a task that is run twice never leaves half a file."""
    buf = io.BytesIO()
    arrays = {f"{kind}{k}{c}": x for kind, pairs in (("l", model.levels), ("b", model.back)) for k, pair in enumerate(pairs) for c, x in zip("uv", pair, strict=True)}
    np.savez(buf, parts=model.parts, of_counts=model.of_counts, **arrays)
    fs, at = C.filesystem(model_file(where, lang, half, part))
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    new = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as out:
        out.write(buf.getvalue())
    fs.move(new, at)


_models: dict[str, KneserNey | None] = {}


def load_model(where: str, lang: str, half: int, part: int | None = None) -> KneserNey | None:
    """The model of the lower orders, or a part of those above. None where no text of the language is in that half, or no n-gram in that part."""
    name = model_file(where, lang, half, part)
    if name not in _models:
        fs, at = C.filesystem(name)
        model = None
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            with fs.open_input_file(at) as f:
                got = np.load(io.BytesIO(f.read()))
                model = KneserNey.__new__(KneserNey)
                model.below = None if part is None else load_model(where, lang, half)
                model.least = 1 if model.below is None else model.below.least + len(model.below.levels)
                model.parts, model.of_counts = int(got["parts"]), got["of_counts"]
                many = sum(x.startswith("l") and x.endswith("u") for x in got.files)
                model.levels, model.back = ([(got[f"{kind}{k}u"], got[f"{kind}{k}v"]) for k in range(many)] for kind in "lb")
        held = sum(m.nbytes for m in _models.values() if m)
        while _models and held + (model.nbytes if model else 0) > HELD_BYTES:
            old = _models.pop(next(iter(_models)))
            held -= old.nbytes if old else 0
        _models[name] = model
    return _models[name]


def log2_by(where: str, lang: str, half: int, x: np.ndarray) -> np.ndarray | None:
    """log2 probability of the last unit of each n-gram under the language's model of that half, a part at a time."""
    whole = load_model(where, lang, half)
    if whole is None:
        return None
    u, inv = np.unique(x, return_inverse=True)
    part = parts_of(u, whole.parts)
    p = np.empty(len(u))
    for k in np.flatnonzero(np.bincount(part)).tolist():
        m = part == k
        p[m] = (load_model(where, lang, half, k) or whole).prob(u[m])
    return np.log2(p)[inv]


def base_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = C.Words(texts)
    strings = texts.to_pylist()
    out = {k: np.zeros(len(strings), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    chars = np.fromiter((len(w.decode()) for w in words.words), np.int64, len(words.words))
    sums = np.concatenate([[0], np.cumsum(chars[words.codes])])
    out["word_chars"] = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
    for k, s in enumerate(strings):
        raw = s.encode()
        out["n_symbols"][k] = np.isin(np.frombuffer(raw, np.uint8), SYMBOLS).sum() if any(c in raw for c in b"#*$%&|<>") else 0
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
        ids = words.of(k)
        n = len(ids) - 4
        if n > 1:
            a = np.unique(ids, return_inverse=True)[1]
            if len(a) < 1 << 31:
                m = int(a.max()) + 1
                if m <= 4096:  # five words fit in one number
                    w = (((a[:n] * m + a[1 : n + 1]) * m + a[2 : n + 2]) * m + a[3 : n + 3]) * m + a[4 : n + 4]
                else:
                    two = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
                    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
                    w = four[:n] * m + a[4 : n + 4]
                inv, c = np.unique(w, return_inverse=True, return_counts=True)[1:]
                twice = np.flatnonzero(c[inv] > 1)
                if len(twice):
                    cover = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(cover, twice, 1)
                    np.add.at(cover, twice + 5, -1)
                    out["n_repeat_words"][k] = (np.cumsum(cover[:-1]) > 0).sum()
    return {"n_words": words.counts} | out


def score_quality(docs: DataFrame, band: tuple[float, float] = BAND, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc_id, the statistics of each whole text, base_failed, log2 perplexity (per unit, under its language's model), the
    language's band and kept.

    Kept is false if base_failed, or if the perplexity lies outside the band, which is the median of the language's documents that
    did not fail, less and plus so many spreads; perplexities that are equal to STEPS-ths of a bit tie. A null language is one of its own;
    so is each value of lang. A language of which the other half of texts is empty has no perplexity (null) and no band, and keeps what the
    word rules keep. Null texts count as empty, have no words and fail; equal texts of one language get equal verdicts; an
    empty table gives no rows. A very long text is read in pieces; its words are held at once. Two passes over the texts, one for
    counts and one for scores; neither shuffles text. Where a language's model is larger than HELD_BYTES, each piece of text reads its parts anew.
    """
    spark = docs.sparkSession
    where = C.scratch(spark, "models")
    # an unknown language must not meet the empty string
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"), C.text_hash().alias("text_hash"))

    def by_language(b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The languages of a batch, and for each text its language's number and its half."""
        lang = b.column("lang").dictionary_encode()
        return lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), b.column("text_hash").to_numpy() & 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, half), got in held.items():
                code, n = (np.concatenate(x) for x in zip(*got, strict=True))
                u, inv = np.unique(code, return_inverse=True)
                total = np.bincount(inv, n).astype(np.int64)
                for at in range(0, len(u), 1 << 16):
                    x, y = u[at : at + (1 << 16)], total[at : at + (1 << 16)]
                    yield pa.record_batch({"lang": pa.array([lang] * len(x), pa.string()), "half": pa.array(np.full(len(x), half, np.int32)), "code": pa.array(x), "n": pa.array(y)})
            held.clear()

        for b in C.slabs(batches, size=2 << 20):
            names, lang, half = by_language(b)
            group = lang * 2 + half
            for code, owner in grams(*units(b.column("text"))):
                own = group[owner]
                for g in np.flatnonzero(np.bincount(own)).tolist():
                    u, n = np.unique(code[own == g], return_counts=True)
                    held.setdefault((names[g // 2], g % 2), []).append((u, n))
                    size += len(u)
            if size > 1 << 21:
                yield from flush()
                size = 0
        yield from flush()

    def learn_whole(t: pa.Table, size: pa.Table) -> pa.Table:
        """Writes the lower orders of the model of a language and half."""
        lang, half, parts, *of_counts = (c[0].as_py() for c in size.columns)
        model = KneserNey(t.column("code").to_numpy(), t.column("n").to_numpy(), WHOLE, None, np.array(of_counts, np.float64).reshape(-1, 4), parts)
        save_model(where, lang, half, model)
        return pa.table({"grams": pa.array([t.num_rows], pa.int64())})

    def learn_part(t: pa.Table) -> pa.Table:
        """Writes a part of the orders above."""
        lang, half, part = (t.column(c)[0].as_py() for c in ("lang", "half", "part"))
        whole = load_model(where, lang, half)
        save_model(where, lang, half, KneserNey(t.column("code").to_numpy(), t.column("n").to_numpy(), ORDER, whole, whole.of_counts), part)
        _models.clear()
        return pa.table({"grams": pa.array([t.num_rows], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, parts = b.column("code").to_numpy(), b.column("parts").to_numpy()
                part = np.zeros(len(code), np.int32)
                for many in np.unique(parts[parts > 1]).tolist():
                    part[parts == many] = parts_of(code[parts == many], many)
                yield pa.record_batch({"lang": b.column("lang"), "half": b.column("half"), "part": pa.array(part), "code": b.column("code"), "n": b.column("n")})

    key = ["lang", "half"]
    counts = docs.select("text", "lang", "text_hash").mapInArrow(C.lean(count), "lang string, half int, code long, n long").groupBy(*key, "code").agg(F.sum("n").alias("n"))
    levels = {ORDER: C.materialize(counts, "grams")}
    for k in range(ORDER - 1, WHOLE - 1, -1):
        levels[k] = levels[k + 1].groupBy(*key, (F.col("code") % CLASSES**k).alias("code")).agg(F.count("*").alias("n"))
        if k > WHOLE:  # read twice
            levels[k] = C.materialize(levels[k], "grams")
    sizes = levels[ORDER].groupBy(*key).agg(F.ceil(F.count("*") / PART_GRAMS).cast("int").alias("parts"))
    for k in range(ORDER, WHOLE, -1):
        sizes = sizes.join(levels[k].groupBy(*key).agg(*[F.count_if(F.col("n") == m).alias(f"n{k}_{m}") for m in range(1, 5)]), key)
    sizes = C.materialize(sizes, "sizes")  # a row for each language and half
    levels[WHOLE].groupBy(*key).cogroup(sizes.groupBy(*key)).applyInArrow(C.tidied(learn_whole), "grams long").agg(F.sum("grams")).first()
    dealt = levels[ORDER].join(sizes.select(*key, "parts"), key).mapInArrow(C.lean(deal), "lang string, half int, part int, code long, n long")
    dealt.groupBy(*key, "part").applyInArrow(C.tidied(learn_part), "grams long").agg(F.sum("grams")).first()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slabs(batches, size=2 << 20):
            names, lang, half = by_language(b)
            stats = base_stats(b.column("text"))
            group, rows = lang * 2 + half, b.num_rows
            sums, squares, units_ = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
            for code, owner in grams(*units(b.column("text"))):
                own = group[owner]
                for g in np.flatnonzero(np.bincount(own)).tolist():
                    m = np.flatnonzero(own == g)
                    bits = log2_by(where, names[g // 2], 1 - g % 2, code[m])
                    if bits is not None:
                        sums += np.bincount(owner[m], bits, rows)
                        squares += np.bincount(owner[m], bits**2, rows)
                        units_ += np.bincount(owner[m], minlength=rows)
            perplexity = pa.array(-sums / np.maximum(units_, 1), mask=units_ == 0)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "lang": b.column("lang"), **{k: pa.array(v) for k, v in stats.items()}, "log2_perplexity": perplexity, "sums": pa.array(np.round(-sums * STEPS).astype(np.int64)), "squares": pa.array(np.round(squares * STEPS).astype(np.int64)), "units": pa.array(units_)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scores(batches)
        finally:  # a worker that lives on holds none
            _models.clear()

    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    scored = C.materialize(docs.mapInArrow(C.lean(score), "doc_id long, text_hash long, lang string, " + ", ".join(f"{c} long" for c in cols) + ", log2_perplexity double, sums long, squares long, units long"), "quality")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("at", F.round(F.col("log2_perplexity") * STEPS).cast("long"))
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("sums", "squares", "units")]
    steps = scored.where(~F.col("base_failed") & F.col("at").isNotNull()).groupBy("lang", "at").agg(F.count("*").alias("rows"), *sums)
    upto = F.sum("rows").over(Window.partitionBy("lang").orderBy("at"))  # a row for each step of a bit
    steps = steps.withColumn("upto", upto).withColumn("all", F.sum("rows").over(Window.partitionBy("lang")))
    quantile = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("at"))) / STEPS).alias(f"q{int(100 * q)}")
    bands = steps.groupBy("lang").agg(quantile(0.25), quantile(0.5), quantile(0.75), *[F.sum(c).cast("double").alias(f"all_{c}") for c in ("sums", "squares", "units")])
    mean = F.col("all_sums") / STEPS / F.col("all_units")
    own = F.greatest((F.col("q75") - F.col("q25")) / 1.349, F.lit(LEAST_SPREAD))
    bands = bands.select("lang", "q50", own.alias("own"), F.greatest(F.col("all_squares") / STEPS / F.col("all_units") - mean * mean, F.lit(0.0)).alias("v"))
    bands = C.materialize(bands, "bands")  # a row for each language; a table of known size, so that Spark sends it whole only if it is small
    spread = F.sqrt(F.col("own") * F.col("own") + RUN**2 * F.col("v") / F.greatest("units", F.lit(1)))
    scored = scored.join(bands, "lang", "left").withColumn("band_low", F.col("q50") - band[0] * spread).withColumn("band_high", F.col("q50") + band[1] * spread)
    inside = F.coalesce(F.col("log2_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return scored.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", *cols, "base_failed", "kept", "log2_perplexity", "band_low", "band_high", "text_hash")
