"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.storage import free_name

UNKNOWN = "und"
WIDTHS, FILTERS = (2, 3, 4), 16
WINDOW = 256
#: The sample that the network is fitted on: so many documents of each language, and a passage of each.
DOCS_PER_LANGUAGE, PASSAGE, MOST_LANGUAGES = 400, 512, 100
#: A text stays in the corpus if its windows are, on the mean by bytes, at least so surely in one language or another.
LEAST_SURE = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = r"\p{L}"


def fold(doc_id: str) -> Column:
    """crc32 of the identifier as text, modulo 4 (a null identifier is the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


@dataclass
class Network:
    """Filters as tables: what each byte at each place of a filter adds to its output."""

    languages: list[str]
    filters: list[np.ndarray]  # (width, 256, FILTERS) for each width
    shifts: np.ndarray  # (len(WIDTHS) * FILTERS)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray

    def compiled(self) -> list[list[tuple[int, np.ndarray, bool]]]:
        """For each width the tables to add up: (offset, table, whether it is by pairs of bytes)."""
        out = []
        for taps in self.filters:
            parts: list[tuple[int, np.ndarray, bool]] = []
            for j in range(0, len(taps) - 1, 2):
                pairs = (taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, -1)
                parts.append((j, np.ascontiguousarray(pairs, np.float32), True))
            if len(taps) % 2:
                parts.append((len(taps) - 1, np.ascontiguousarray(taps[-1], np.float32), False))
            out.append(parts)
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        """(windows, languages): convolution, maximum over places, softmax."""
        pooled = np.empty((len(windows), len(self.shifts)), np.float32)
        for at in range(0, len(windows), 32):
            part = windows[at : at + 32]
            single = part.astype(np.intp)
            pairs = single[:, :-1] << 8 | single[:, 1:]
            for n, (width, parts) in enumerate(zip(WIDTHS, tables)):
                size = WINDOW - width + 1
                total = None
                for offset, table, paired in parts:
                    index = (pairs if paired else single)[:, offset : offset + size]
                    found = table.take(index, axis=0)
                    total = found if total is None else np.add(total, found, out=total)
                pooled[at : at + 32, n * FILTERS : (n + 1) * FILTERS] = total.max(axis=1)
        hidden = np.maximum(pooled + self.shifts, 0)
        scores = hidden @ self.weights + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as windows of fixed length, the last one filled up with zeros; the text and size of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-sizes // WINDOW)
    first = np.cumsum(count) - count
    flat = np.frombuffer(b"".join(texts), np.uint8)
    grid = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    grid[np.arange(len(flat)) + np.repeat(first * WINDOW - (np.cumsum(sizes) - sizes), sizes)] = _FOLD[flat]
    owner = np.repeat(np.arange(len(texts)), count)
    used = np.minimum(WINDOW, np.repeat(sizes, count) - WINDOW * (np.arange(len(owner)) - np.repeat(first, count)))
    return grid.reshape(-1, WINDOW), owner, used


def sample(docs: DataFrame, doc_id: str, text: str, label: str, held_out: int) -> list[tuple[str, str]]:
    """(language, passage) of at most DOCS_PER_LANGUAGE documents of the MOST_LANGUAGES most frequent languages.

    The choice is by a hash of the document, and the passage begins at a hashed place.  Only passages are ranked, of about
    four times as many documents as are needed, however large the table.
    """
    usable = docs.where((fold(doc_id) != held_out) & F.col(label).isNotNull() & F.col(text).rlike(_LETTER))
    counts = usable.groupBy(F.col(label).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    if not found:
        return []
    draw = F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text))
    # draws are uniform, so the lowest of a language lie below this with a wide margin, and few others do
    below = {k: min(1.0, 4 * DOCS_PER_LANGUAGE / n) * 2.0**64 - 2.0**63 for k, n in found.items()}
    limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    begin = F.lit(1) + F.pmod(draw, F.greatest(F.length(text) - PASSAGE, F.lit(1)))
    passage = F.substring(F.col(text), begin.cast("int"), F.lit(PASSAGE))
    rows = usable.where(draw.cast("double") <= limits[F.col(label)]).select(F.col(label).alias("lang"), draw.alias("draw"), passage.alias("passage"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "passage"))
    chosen = rows.select("*", rank.alias("n")).where(F.col("n") <= DOCS_PER_LANGUAGE)
    return sorted((r["lang"], r["passage"]) for r in chosen.select("lang", "passage").collect())


def train(examples: list[tuple[str, str]], seed: int = 11, epochs: int = 10, batch: int = 64, rate: float = 0.01) -> Network:
    """Fit the network in numpy with Adam.

    Some windows are cut short, and some repeat a short passage, since documents can be short and can repeat themselves.
    """
    draw = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in examples})
    grids, labels = [], []
    for lang, text in examples:
        raw = text.encode("utf-8", "replace")
        for piece in (raw[i : i + WINDOW] for i in range(0, max(1, len(raw)), WINDOW)):
            kind = draw.random()
            if kind < 0.4:
                piece = piece[: draw.integers(8, WINDOW)]
            elif kind < 0.65:
                at = draw.integers(0, max(1, len(piece) - 40))
                piece = (piece[at : at + draw.integers(6, 40)] * WINDOW)[:WINDOW]
            grids.append(windows_of([piece or b" "])[0])
            labels.append(languages.index(lang))
    x, y = np.concatenate(grids), np.array(labels)
    size = len(WIDTHS) * FILTERS
    net = Network(
        languages, [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32),
        draw.normal(0, 0.2, (size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    for taps in net.filters:
        taps[:, 0, :] = 0  # filling counts for nothing
    params = [*net.filters, net.shifts, net.weights, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        mixed = draw.permutation(len(x))
        for at in range(0, len(x), batch):
            chosen = mixed[at : at + batch]
            part, pooled, places = x[chosen].astype(np.intp), [], []
            for width, taps in zip(WIDTHS, net.filters):
                length = WINDOW - width + 1
                total = taps[0].take(part[:, :length], axis=0)
                for j in range(1, width):
                    total += taps[j].take(part[:, j : j + length], axis=0)
                places.append(total.argmax(axis=1))
                pooled.append(np.take_along_axis(total, places[-1][:, None, :], axis=1)[:, 0])
            before = np.concatenate(pooled, axis=1) + net.shifts
            hidden = np.maximum(before, 0)
            scores = hidden @ net.weights + net.bias
            chance = np.exp(scores - scores.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), y[chosen]] -= 1
            chance /= len(chosen)
            back = (chance @ net.weights.T) * (before > 0)
            grads: list[np.ndarray] = []
            for n, (width, taps) in enumerate(zip(WIDTHS, net.filters)):
                grad, own = np.zeros_like(taps), back[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(width):
                    seen = np.take_along_axis(part, places[n] + j, axis=1)
                    np.add.at(grad[j], (seen, np.arange(FILTERS)[None, :]), own)
                grad[:, 0, :] = 0
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ chance, chance.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", held_out: int = 2,
    predicted: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` (0 to 1).

    A byte network is fitted on a bounded sample of the labelled documents outside the fold ``held_out`` and applied to
    all windows of every whole text; a document's score is the softmax of the mean log probabilities, weighted by
    bytes.  The label is not an input of a prediction.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing is labelled.
    Labels that are null or beyond the most frequent hundred are not learned.  Null and repeated identifiers are
    as good as others.  An empty table gives an empty result.  Other columns stay; the new ones get a
    longer name if theirs is taken.
    """
    return _identified(docs, _fitted(docs, doc_id, text, label, held_out), text, predicted, score)


def _fitted(docs: DataFrame, doc_id: str, text: str, label: str, held_out: int) -> Network | None:
    examples = sample(docs, doc_id, text, label, held_out)
    return train(examples) if examples else None


def _identified(docs: DataFrame, net: Network | None, text: str, predicted: str, score: str, sure: str | None = None) -> DataFrame:
    """As ``identify``; ``sure`` names a further column, the mean by bytes of each window's highest probability."""
    predicted, score, lettered = free_name(docs, predicted), free_name(docs, score), free_name(docs, "_lettered")
    rows = docs.withColumn(lettered, F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())])
    if sure:
        schema = schema.add(T.StructField(sure, T.DoubleType()))
    at, names = docs.columns.index(text), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.compiled() if net else None
        for batch in batches:
            known = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            langs, scores, sureness = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            group: list[int] = []
            size = 0
            for i in [*(i for i, k in enumerate(known) if k and net), None]:
                if i is not None:
                    group.append(i)
                    size += len(texts[i])
                if group and (i is None or size > 1_000_000):
                    grid, owner, used = windows_of([texts[g].encode("utf-8", "replace") for g in group])
                    logs = net.log_probabilities(grid, tables)
                    highest = np.bincount(owner, np.exp(logs.max(axis=1)) * used, len(group)) / np.bincount(owner, used, len(group))
                    logs = logs * used[:, None]
                    total = np.stack([np.bincount(owner, c, len(group)) for c in logs.T], axis=1)
                    total /= np.bincount(owner, used, len(group))[:, None]
                    chance = np.exp(total - total.max(axis=1, keepdims=True))
                    chance /= chance.sum(axis=1, keepdims=True)
                    for g, c, h in zip(group, chance, highest):
                        langs[g], scores[g], sureness[g] = net.languages[int(c.argmax())], float(c.max()), float(h)
                    group, size = [], 0
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sureness, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found[: 3 if sure else 2]], names)

    return rows.mapInArrow(run, schema)


def drop_unidentified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``docs`` without the texts that are in no language: null, empty, without a letter, or unclear to the network.

    A text is unclear if the mean by bytes of its windows' highest probabilities is below LEAST_SURE, so a text in
    several languages is not.  The bound has no effect with one or two languages, where it is never passed under.  Where
    nothing is labelled there is no network, and every text with a letter stays.
    """
    net = _fitted(docs, doc_id, text, label, held_out=2)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if net is None:
        return docs.where(F.col(text).rlike(_LETTER)).select(*columns)
    sure = free_name(docs, "_sure")
    found = _identified(docs, net, text, free_name(docs, "lang_pred"), free_name(docs, "score"), sure)
    # the rows without a letter have 0; probabilities are single precision
    return found.where(F.col(sure) >= LEAST_SURE - 1e-6).select(*columns)
