"""Language identification in two steps: the family first, then one language against another in it.

Texts are vectors of hashed two- and three-byte sequences. A linear support vector machine for each
pair of families, and for each pair of languages of a family, is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import remainder_is, sampled, slices

#: Families of languages; a language that is not named is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "hi": "indic", "ur": "indic", "bn": "indic", "tr": "turkic", "az": "turkic",
}
#: Dimensions of two-byte and of three-byte sequences.
PAIRS, TRIPLES = 1024, 3072
DIMENSIONS = PAIRS + TRIPLES
#: Texts of each language that the machines are fitted on at most.
PER_LANGUAGE = 1000
#: Weight of the squared norm, rounds of the fit, steepness of the score.
PENALTY, ROUNDS, STEEPNESS = 1e-4, 150, 3.0
MODULUS, REMAINDER = 4, 2
UNKNOWN = "und"
#: Bytes of text whose vectors are made at once, and positions that are counted at once.
PART_BYTES, BLOCK = 2 << 20, 1 << 20
#: Texts whose vectors are made at once: each takes 32 kB, however short it is.
PART_ROWS = 512


def vectors(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of each sequence, lower-cased; length 1 in each of the two parts."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(sizes)
    counts = np.zeros(len(texts) * DIMENSIONS, np.float64)
    for at in range(0, len(data), BLOCK):
        piece = data[at : at + BLOCK + 2].astype(np.uint32)
        place = np.arange(at, at + min(BLOCK, len(piece)))
        row = np.searchsorted(ends, place, side="right")
        left = ends[row] - place
        n = len(place)
        for width, start, dims in ((2, 0, PAIRS), (3, PAIRS, TRIPLES)):
            inside = np.flatnonzero(left[: len(piece) - width + 1] >= width)
            inside = inside[inside < n]
            key = piece[inside]
            for i in range(1, width):
                key = key * np.uint32(257) + piece[inside + i]
            key = (key * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(dims)
            counts += np.bincount(row[inside] * DIMENSIONS + start + key, minlength=len(counts))
    out = counts.reshape(-1, DIMENSIONS)
    for a, b in ((0, PAIRS), (PAIRS, DIMENSIONS)):
        total = out[:, a:b].sum(axis=1, keepdims=True)
        out[:, a:b] = np.sqrt(out[:, a:b] / np.maximum(total, 1))
    return out.astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps."""
    n, dim = x.shape
    w, ahead = np.zeros(dim + 1, np.float32), np.zeros(dim + 1, np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (2 * 3 + PENALTY)
    for k in range(ROUNDS):
        short = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * y * share
        grad = np.append(-2 * (short @ x), -2 * short.sum()).astype(np.float32)
        grad[:-1] += PENALTY * ahead[:-1]
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Machines for pairs of families and for pairs of languages of each family."""

    def __init__(self, x: np.ndarray, languages: list[str], families: Mapping[str, str]):
        names = np.array(languages, dtype=object)
        family = np.array([families.get(n, f"={n}") for n in languages], dtype=object)
        self.families = {f: sorted(set(names[family == f])) for f in sorted(set(family))}
        self.between = self._machines(x, family, list(self.families))
        self.within = {f: self._machines(x[family == f], names[family == f], own) for f, own in self.families.items()}

    @staticmethod
    def _machines(x: np.ndarray, kind: np.ndarray, names: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i, j in combinations(range(len(names)), 2):
            used = (kind == names[i]) | (kind == names[j])
            out.append((i, j, fit(x[used], np.where(kind[used] == names[i], 1.0, -1.0).astype(np.float32))))
        return out

    @staticmethod
    def _decide(x: np.ndarray, n: int, machines: list) -> tuple[np.ndarray, np.ndarray]:
        """The name that wins most pairs, ties by summed scores, and its mean score over its pairs."""
        votes, scores = np.zeros((len(x), n)), np.zeros((len(x), n))
        for i, j, w in machines:
            p = 1 / (1 + np.exp(-STEEPNESS * (x @ w[:-1] + w[-1]).astype(float)))
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
            scores[:, i] += p
            scores[:, j] += 1 - p
        best = (votes + scores / (n + 1)).argmax(axis=1)
        mean = scores[np.arange(len(x)), best] / max(n - 1, 1) if n > 1 else np.ones(len(x))
        return best, mean

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = list(self.families)
        out, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if names:
            best, sure = self._decide(x, len(names), self.between)
            for k, family in enumerate(names):
                rows = np.flatnonzero(best == k)
                own = self.families[family]
                inner, more = self._decide(x[rows], len(own), self.within[family])
                out[rows], score[rows] = np.array(own, dtype=object)[inner], sure[rows] * more
        return out, score


def learn(docs: DataFrame, families: Mapping[str, str] = FAMILIES, most: int = PER_LANGUAGE) -> Model:
    """The machines of at most ``most`` texts of each language; their vectors reach the driver."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~remainder_is(F.col("doc_id"), MODULUS, REMAINDER))
    rows = sampled(known.select("lang", "doc_id", "text"), "lang", most, "lang-1", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES, PART_ROWS):
                x = vectors(part.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"]
                )

    got = rows.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    order = np.argsort(np.array([a + b.hex()[:64] for a, b in zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True)]))
    languages = [got["lang"].to_pylist()[i] for i in order]
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIMENSIONS)[order].astype(np.float32)
    return Model(x, languages, families)


def identify(docs: DataFrame, families: Mapping[str, str] = FAMILIES, most: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text.

    Learns from texts with a language whose id's crc32 mod 4 is not 2; a null id is not held out.
    Prediction reads the text alone, whole.

    ``und`` with score 0 is the answer for a null text and one without a letter, and for all texts
    where there is nothing to learn from; a single language is always the answer, with score 1.
    Every row gives one row, repeated rows too. Columns other than doc_id, text and lang are not read, so
    they cannot clash. An empty table gives an empty result.
    """
    model = learn(docs, families, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES, PART_ROWS):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                names, score = model.predict(vectors(texts))
                none = np.array([letter.search(t) is None for t in texts], bool)
                names[none], score[none] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", remainder_is(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
