"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit has a binary linear classifier over hashed byte n-grams of the lower-case
letters. A text's margins are decoded to the codeword of least loss, each bit weighted by what it got right on the
sample beyond chance; a runner-up that comes close flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship

ORDERS = (2, 3, 4)
BITS = 14
WIDTH = len(ORDERS) << BITS
CHUNK = 1 << 20

_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray | None:
    """Shares of hashed byte n-grams of the whole text, a block for each order; None without a letter."""
    if not _LETTER(text):
        return None
    data = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    # Runs of what is no letter count as one space.
    data = data[np.append(True, (data[1:] != 0x20) | (data[:-1] != 0x20))]
    out = np.zeros(WIDTH)
    for at in range(0, len(data), CHUNK):
        own = data[at : at + CHUNK + max(ORDERS) - 1]
        for k, n in enumerate(ORDERS):
            size = min(CHUNK, len(own) - n + 1)
            if size <= 0:
                continue
            h = own[:size].copy()
            for j in range(1, n):
                h = h * np.uint32(0x01000193) + own[j : j + size]
            h = h * np.uint32(2654435761) >> np.uint32(32 - BITS)
            out[k << BITS : k + 1 << BITS] += np.bincount(h, minlength=1 << BITS)
    total = out.sum()
    return out / total if total else None


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all distinct splits up to seven languages, beyond that the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        cols = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, dtype=np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        least = int(((m[:, None, :] != m[None, :, :]).sum(-1) + width * np.eye(n, dtype=int)).min())
        if least > far and (np.abs(m.sum(0)) < n).all():
            best, far = m, least
    return best


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ x.astype(np.float32)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, its share of the decoded probability, and whether the runner-up comes within 0.2."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = np.logaddexp(0, -2 * self.codes * (margins * self.scale)) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.langs[first], float(p[first]), bool(p[first] - p[second] < 0.2)


def sample(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """About ``per_language`` whole texts of each language at most, drawn by a hash of id over all labelled rows that are not held out."""
    rows = docs.select(docs[doc_id].alias("k"), docs[text].alias("text"), docs[lang].alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("k").cast("string").cast("binary")) % 4 != 2))
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return rows.select("lang", "text").limit(0)
    draw = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in share.items() for x in kv)), F.col("lang"))
    return rows.filter(draw < rate).select("lang", "text").repartition(8)


def train(docs: DataFrame, per_language: int = 1500, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fits the classifiers; None without a labelled text. Only a sum for each language of the sample reaches the driver.

    Rows without an id, a text, a language or a letter are not learned from; very long texts count whole, repeated rows each;
    a language with few texts gives all it has; extra columns are ignored, whatever their names; an empty table gives no model.
    """
    ship(docs.sparkSession)
    drawn = materialize(sample(docs, per_language, doc_id, text, lang), "langid-sample")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := features(t)) is not None:
                    own = sums.setdefault(name, [0, np.zeros(WIDTH)])
                    own[0] += 1
                    own[1] += x
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1].tobytes() for _, v in rows], pa.binary())], names=["lang", "n", "sums"])

    # The parts of each language are added by a task of its own, a few of a fixed size for each task that read the sample.
    def add(parts: pa.Table) -> pa.Table:
        rows = sorted(zip(parts["n"].to_pylist(), parts["sums"].to_pylist(), strict=True))
        total = np.sum([np.frombuffer(x) for _, x in rows], axis=0)
        return pa.table({"lang": parts["lang"][:1], "n": pa.array([sum(n for n, _ in rows)], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, n long, sums binary"
    totals = {r["lang"]: (r["n"], np.frombuffer(r["sums"])) for r in drawn.mapInArrow(profile, schema).groupBy("lang").applyInArrow(add, schema).collect()}
    if not totals:
        discard(drawn)
        return None
    langs = sorted(totals)
    means = np.array([totals[x][1] / totals[x][0] for x in langs])
    codes = codewords(len(langs))
    floor = 0.5 / WIDTH

    def side(sign: int, bit: int) -> np.ndarray:
        own = means[codes[:, bit] == sign]
        return np.log((own.mean(0) if len(own) else means.mean(0)) + floor)

    weights = np.array([side(1, b) - side(-1, b) for b in range(codes.shape[1])], dtype=np.float32)
    model = Model(langs, codes, weights, np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    where = {x: i for i, x in enumerate(langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, right, n = np.zeros(codes.shape[1]), np.zeros(codes.shape[1]), 0
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := features(t)) is not None:
                    m = model.margins(x)
                    n += 1
                    size += np.abs(m)
                    right += m * codes[where[name]] > 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size.tolist()], pa.list_(pa.float64())), pa.array([right.tolist()], pa.list_(pa.float64()))], names=["n", "size", "correct"])

    rows = sorted(drawn.mapInArrow(measure, "n long, size array<double>, correct array<double>").collect(), key=lambda r: (r["n"], r["size"]))
    n = max(1, sum(r["n"] for r in rows))
    size, right = np.sum([r["size"] for r in rows], 0) / n, np.sum([r["correct"] for r in rows], 0) / n
    trust = np.maximum(right - 0.5, 1e-3)
    discard(drawn)
    model.scale, model.trust = 1 / np.maximum(size, 1e-9), trust * len(trust) / trust.sum()
    return model


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of each row with lang_pred, score and ambiguous.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text where no model could be
    fitted. Of languages that decode equally well the first by name wins, flagged as ambiguous. Very long texts count
    whole, in pieces of bounded size; null ids and repeated rows give results like any others; other columns are ignored,
    whatever their names; an empty table gives no rows. No row meets another: there is no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)).to_pylist():
                x = features(t) if t and own else None
                rows.append(own.decode(own.margins(x)) if x is not None else ("und", 0.0, False))
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, docs[text].alias("__langid_text")).mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")
