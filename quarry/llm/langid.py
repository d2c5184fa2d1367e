"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, found by
a forward algorithm; a text's is the product over its words. Piece
probabilities are learned by expectation-maximisation (forward-backward) on a
bounded sample of labelled rows, one language to a task.

A long word is cut where no piece of the vocabulary crosses: every segmentation has
a border there, so that the word's sum is the product of its spans' sums, and a
long word is scored whole at the cost of its spans. Pieces of all lengths take
part, and so do all languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocabulary
from ._util import slices

#: Training rows of a language at most.
ROWS_PER_LANGUAGE = 400
#: Rows that the sample is ranked among, as a multiple of those wanted.
MARGIN = 3
ROUNDS = 4
#: Added to every piece's expected count.
SMOOTHING = 0.01
#: Scores (words by languages) that a worker keeps.
KEPT_SCORES = 800_000
#: Spans by languages that are worked on together.
TOGETHER = 1 << 17
#: Languages that are scored together.
LANGUAGES_TOGETHER = 64
#: Bytes of words that are searched for pieces together.
WINDOW = 1 << 20
#: Spans of up to so many bytes are summed as they are, longer ones by logarithms.
SHORT = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class PieceTable:
    """Hash table from a substring's rolling hash to the piece's number."""

    def __init__(self, vocabulary_pieces: list[bytes]) -> None:
        self.size = len(vocabulary_pieces)
        self.lengths = sorted({len(p) for p in vocabulary_pieces if p})
        self.bits = max(8, (self.size * 16).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.numbers = np.full(1 << self.bits, self.size, dtype=np.int32)
        self.probes = 1
        mask = (1 << self.bits) - 1
        with np.errstate(over="ignore"):
            for i, piece in enumerate(vocabulary_pieces):
                h = np.uint64(0)
                for b in piece:
                    h = h * _BASE + np.uint64(b + 1)
                slot, probes = int((h * _SPREAD) >> np.uint64(64 - self.bits)), 1
                while self.numbers[slot] != self.size:
                    slot, probes = (slot + 1) & mask, probes + 1
                self.keys[slot], self.numbers[slot] = h, i
                self.probes = max(self.probes, probes)
            power = [np.uint64(1)]
            for _ in range(max(self.lengths, default=0)):
                power.append(power[-1] * _BASE)
        self.power = power

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces; ``size`` where there is none."""
        slot = ((hashes * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.numbers[slot], self.size)
        open_ = np.flatnonzero((found == self.size) & (self.numbers[slot] != self.size))
        for j in range(1, self.probes):
            if not len(open_):
                break
            next_ = (slot[open_] + j) & ((1 << self.bits) - 1)
            found[open_] = np.where(self.keys[next_] == hashes[open_], self.numbers[next_], self.size)
            open_ = open_[(found[open_] == self.size) & (self.numbers[next_] != self.size)]
        return found


def prefix_hashes(letters: np.ndarray) -> np.ndarray:
    """Rolling hash of all that stands before each place, modulo 2**64; one step for each of 2**k lengths, by doubling."""
    values = letters.astype(np.uint64) + np.uint64(1)
    power, step = _BASE, 1
    with np.errstate(over="ignore"):
        while step < len(values):
            head = values[:-step] * power
            values = values.copy()
            values[step:] += head
            power, step = power * power, step * 2
    return np.concatenate([np.zeros(1, dtype=np.uint64), values])


def spans_of(table: PieceTable, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different spans, span numbers one word after the other, word numbers beside them).

    A space stands before each word. Spans end where no piece crosses; a short
    word is one span.
    """
    spans: dict[bytes, int] = {}
    short = [i for i, w in enumerate(words) if len(w) < SHORT]
    which, owner = [spans.setdefault(b" " + words[i], len(spans)) for i in short], short
    if len(short) < len(words):
        long = [i for i, w in enumerate(words) if len(w) >= SHORT]
        for at, text, ends in _cuts(table, [words[i] for i in long]):
            begin = 0
            for end in ends:
                which.append(spans.setdefault(text[begin:end], len(spans)))
                owner.append(long[at])
                begin = end
    order = np.argsort(np.array(owner, dtype=np.int64), kind="stable")
    return list(spans), np.array(which, dtype=np.int64)[order], np.array(owner, dtype=np.int64)[order]


def _cuts(table: PieceTable, words: list[bytes]):
    """(number, word with its space, ends of its spans) of every word; short words go together by the megabyte."""
    group, size = [], 0
    for i, word in enumerate(words):
        if len(word) >= WINDOW:
            yield i, b" " + word, _ends_of_long(table, b" " + word)
        else:
            group.append((i, b" " + word))
            size += len(word) + 1
        if group and (size >= WINDOW or i == len(words) - 1):
            starts = np.cumsum([0] + [len(t) for _, t in group])
            at = np.flatnonzero(_borders(table, b"".join(t for _, t in group), starts))
            first = np.searchsorted(at, starts)
            for (j, text), a, b, s in zip(group, first[:-1].tolist(), first[1:].tolist(), starts[:-1].tolist(), strict=True):
                yield j, text, (at[a + 1 : b + 1] - s).tolist()
            group, size = [], 0


def _ends_of_long(table: PieceTable, text: bytes) -> list[int]:
    """The same for one word, a window at a time; what crosses a window's edge lies in its margin."""
    margin, ends = max(table.lengths, default=1), []
    for a in range(0, len(text), WINDOW):
        low, high = max(0, a - margin), min(len(text), a + WINDOW + margin)
        at = np.flatnonzero(_borders(table, text[low:high], np.array([0, high - low]))) + low
        ends += at[(at > a) & (at <= a + WINDOW) & (at < len(text))].tolist()
    return [*ends, len(text)]


def _borders(table: PieceTable, text: bytes, starts: np.ndarray) -> np.ndarray:
    """For each place before a letter and the end, whether no piece of a word crosses it."""
    letters = np.frombuffer(text, dtype=np.uint8)
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    prefix = prefix_hashes(letters)
    crossing = np.zeros(len(letters) + 1, dtype=np.int32)
    for n in table.lengths:
        if n < 2 or n > len(letters):
            continue
        begin = np.flatnonzero(owner[: len(letters) - n + 1] == owner[n - 1 :])
        with np.errstate(over="ignore"):
            there = begin[table.find(prefix[begin + n] - prefix[begin] * table.power[n]) != table.size]
        # Each piece crosses the places from its second letter to its last.
        crossing[there + 1] += 1
        crossing[there + n] -= 1
    border = np.cumsum(crossing) == 0
    border[starts] = True
    return border


def blocks_of(spans: list[bytes], together: int):
    """Spans of one byte length together: (places, matrix of bytes)."""
    lengths = np.array([len(w) for w in spans], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        n = int(lengths[own[0]])
        rows = max(1, min(8192, together // max(1, n // 16)))
        for a in range(0, len(own), rows):
            part = own[a : a + rows]
            yield part, np.frombuffer(b"".join(spans[i] for i in part), dtype=np.uint8).reshape(len(part), n)


def _edges(table: PieceTable, letters: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """For each end, (size, piece numbers) of the sizes at which some span has a piece."""
    n = letters.shape[1]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
    prefix = np.zeros((n + 1, len(letters)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(n):
            prefix[t + 1] = prefix[t] * _BASE + letters[:, t].astype(np.uint64) + np.uint64(1)
        for size in table.lengths:
            if size > n:
                break
            numbers = table.find((prefix[size:] - prefix[:-size] * table.power[size]).reshape(-1)).reshape(n - size + 1, -1)
            for begin in np.flatnonzero((numbers != table.size).any(axis=1)).tolist():
                out[begin + size].append((size, numbers[begin]))
    return out


def forward(logs: np.ndarray, edges, rows: int) -> np.ndarray:
    """By position and span, the logarithm of the summed probability of all segmentations up to there; ``logs`` are the pieces'."""
    alpha = np.full((len(edges), rows), -np.inf)
    alpha[0] = 0
    for end, own in enumerate(edges):
        for size, numbers in own:
            alpha[end] = np.logaddexp(alpha[end], alpha[end - size] + logs[numbers])
    return alpha


def score_spans(table: PieceTable, probabilities: np.ndarray, spans: list[bytes]) -> np.ndarray:
    """Log probability of every span in every language."""
    languages = probabilities.shape[1]
    out = np.full((len(spans), languages), -np.inf)
    short = [i for i, x in enumerate(spans) if len(x) <= SHORT]
    for places, letters in blocks_of([spans[i] for i in short], max(1, TOGETHER // max(1, languages))):
        alpha = np.zeros((letters.shape[1] + 1, len(letters), languages))
        alpha[0] = 1
        for end, own in enumerate(_edges(table, letters)):
            for size, numbers in own:
                alpha[end] += alpha[end - size] * probabilities[numbers]
        with np.errstate(divide="ignore"):
            out[np.array(short)[places]] = np.log(alpha[-1])
    if len(short) < len(spans):
        logs = np.log(probabilities, where=probabilities > 0, out=np.full_like(probabilities, -np.inf))
        for i, span in enumerate(spans):
            if len(span) > SHORT:
                out[i] = score_long(table, logs, span)
    return out


def score_long(table: PieceTable, logs: np.ndarray, span: bytes) -> np.ndarray:
    """The same for one span of any length, by logarithms and a window at a time."""
    margin = max(table.lengths, default=1)
    last = np.full((1, logs.shape[1]), 0.0)  # of the positions up to the window's begin, the latest last
    for a in range(0, len(span), WINDOW):
        low, high = max(0, a - margin), min(len(span), a + WINDOW)
        prefix = prefix_hashes(np.frombuffer(span[low:high], dtype=np.uint8))
        ends, begins, numbers = [], [], []
        for n in table.lengths:
            if n > high - low:
                break
            with np.errstate(over="ignore"):
                found = table.find(prefix[n:] - prefix[:-n] * table.power[n])
            there = np.flatnonzero((found != table.size) & (np.arange(n, high - low + 1) > a - low))
            ends.append(there + n)
            begins.append(there)
            numbers.append(found[there])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        begin, number = np.concatenate(begins)[order], np.concatenate(numbers)[order]
        cuts = np.searchsorted(end[order], np.arange(a - low + 1, high - low + 2)).tolist()
        alpha = np.full((high - low + 1, logs.shape[1]), -np.inf)
        alpha[: a - low + 1] = last
        for e, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False), a - low + 1):
            if y > x:
                alpha[e] = np.logaddexp.reduce(alpha[begin[x:y]] + logs[number[x:y]], axis=0)
        last = alpha[-margin - 1 :] if high < len(span) else alpha[-1:]
    return last[-1]


def score_words(table: PieceTable, probabilities: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probability of every word, with a space before it, in every language; 0 for a word without letters."""
    real = [i for i, w in enumerate(words) if w]
    spans, which, owner = spans_of(table, [words[i] for i in real])
    out = np.zeros((len(words), probabilities.shape[1]))
    if real:
        scores = score_spans(table, probabilities, spans)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[np.array(real)] = np.add.reduceat(scores[which], starts, axis=0)
    return out


def learn_one(table: PieceTable, counts: dict[bytes, int], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the pieces (and a 0 for none) in one language, by expectation-maximisation on counts of words."""
    words = [w for w, n in counts.items() if w and n]
    spans, which, owner = spans_of(table, words)
    weight = np.array([counts[w] for w in words], dtype=np.float64)
    seen = np.bincount(which, weight[owner], minlength=len(spans)) if len(which) else np.zeros(len(spans))
    groups = [(places, _edges(table, letters)) for places, letters in blocks_of(spans, TOGETHER)]
    p = np.append(np.full(table.size, 1.0 / max(1, table.size)), 0.0)
    for _ in range(rounds):
        logs = np.log(p, where=p > 0, out=np.full_like(p, -np.inf))
        expected = np.full(table.size + 1, SMOOTHING)
        for places, edges in groups:
            alpha = forward(logs, edges, len(places))
            # The expected number of borders at a place is dealt out to the pieces that end there, by their share in alpha.
            borders = np.zeros_like(alpha)
            borders[-1] = np.where(np.isfinite(alpha[-1]), seen[places], 0)
            for end in range(len(edges) - 1, 0, -1):
                for size, numbers in edges[end]:
                    into = alpha[end - size] + logs[numbers]
                    there = np.isfinite(into)
                    use = borders[end] * np.exp(into - alpha[end], where=there, out=np.zeros_like(into))
                    expected += np.bincount(numbers, use, minlength=table.size + 1)
                    borders[end - size] += use
        expected[-1] = 0
        p = expected / expected.sum()
    return p


def learn(table: PieceTable, counts: dict[str, dict[bytes, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and probabilities (piece + 1 row of zeros, language)."""
    languages = sorted(counts)
    columns = [learn_one(table, counts[x], rounds) for x in languages]
    return languages, np.stack(columns, axis=1) if columns else np.zeros((table.size + 1, 0))


def words_of(texts: pa.Array) -> pa.Array:
    """Lists of the lower-cased words; where a text begins or ends in white space there are empty ones."""
    return pc.ascii_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))


def fit(docs: DataFrame, train: Column, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(pieces, languages, floors, numbers, probabilities) from at most ``ROWS_PER_LANGUAGE`` rows, the least by a hash of the id, of each language.

    All languages are learned, each in a task of its own. A language's
    probabilities are the floor that smoothing gives any piece, and numbers and
    probabilities of the pieces above it. Rows of a language without a word
    teach nothing, and a language without any is not learned.
    """
    spec = vocabulary.read_spec(vocabulary_path or vocabulary.default_path())
    known = sorted(vocabulary.pieces(spec))
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    sizes = labelled.groupBy("_lang").count()
    # A hash leaves about MARGIN times the rows wanted, so that no task ranks all rows of a language.
    chance = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    # A row per language.
    some = labelled.join(F.broadcast(sizes), "_lang").where(chance * F.col("count") < MARGIN * ROWS_PER_LANGUAGE)
    picked = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ROWS_PER_LANGUAGE)
    # At most ROWS_PER_LANGUAGE ids a language.
    picked = picked.select(F.col("_id"), F.col("_lang")).distinct()
    sample = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("text")).join(F.broadcast(picked), ["_id", "_lang"], "left_semi")

    def count(batches):
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            flat = pa.table([batch.column("_lang").take(pc.list_parent_indices(words)), pc.list_flatten(words).cast(pa.binary())], names=["lang", "word"])
            yield from flat.group_by(["lang", "word"]).aggregate([([], "count_all")]).select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()

    counted = sample.select("_lang", "text").mapInArrow(count, "lang string, word binary, n long").where(F.octet_length("word") > 0)
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def learned(table: pa.Table) -> pa.Table:
        pieces = vocabulary.once_per_worker(sent, PieceTable)
        p = learn_one(pieces, dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True)))[:-1]
        floor = float(p.min())
        above = np.flatnonzero(p > floor)
        return pa.table([pa.array([table.column("lang")[0].as_py()]), pa.array([floor]), pa.array([above.astype(np.int32)], pa.list_(pa.int32())), pa.array([p[above]], pa.list_(pa.float64()))], names=["lang", "floor", "numbers", "p"])

    # A row of some thousand pieces for each language.
    rows = counted.groupBy("lang").applyInArrow(learned, "lang string, floor double, numbers array<int>, p array<double>").orderBy("lang").toArrow()
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in ("numbers", "p")]
    return known, rows.column("lang").to_pylist(), rows.column("floor").to_pylist(), *lists


class Scorer:
    """Scores texts, remembering the words met."""

    def __init__(self, model) -> None:
        known, self.languages, self.floors, self.numbers, self.above = model
        self.table = PieceTable(known)
        self.kept = max(1000, KEPT_SCORES // max(1, len(self.languages)))
        self.number: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def _probabilities(self, some: range) -> np.ndarray:
        p = np.empty((self.table.size + 1, len(some)))
        for j, i in enumerate(some):
            p[:, j] = self.floors[i]
            p[self.numbers[i], j] = self.above[i]
        p[-1] = 0
        return p

    def _score_words(self, words: list[bytes]) -> np.ndarray:
        blocks = [range(a, min(a + LANGUAGES_TOGETHER, len(self.languages))) for a in range(0, len(self.languages), LANGUAGES_TOGETHER)]
        if len(blocks) == 1:
            if not hasattr(self, "_only"):
                self._only = self._probabilities(blocks[0])
            return score_words(self.table, self._only, words)
        return np.concatenate([score_words(self.table, self._probabilities(b), words) for b in blocks], axis=1)

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        languages, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return languages, scores
        has = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
        sizes = np.where(has, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0)
        # In groups of about a megabyte, so that memory follows neither batch nor table.
        places = np.flatnonzero(has)
        for group in np.split(places, np.flatnonzero(np.diff(np.cumsum(sizes[places]) >> 20)) + 1):
            if len(group):
                self._score(texts.take(pa.array(group)), group, languages, scores)
        return languages, scores

    def _score(self, texts: pa.Array, places: np.ndarray, languages, scores) -> None:
        split = words_of(texts)
        coded = pc.list_flatten(split).cast(pa.large_binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.number]
        if new:
            if len(self.number) + len(new) > self.kept:
                self.number, self.scores, new = {}, self.scores[:0], words
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self._score_words(new)])
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        # Each text has a word, as it has a letter.
        total = np.add.reduceat(self.scores[at], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
        total -= total.max(axis=1, keepdims=True)
        posterior = np.exp(total)
        posterior /= posterior.sum(axis=1, keepdims=True)
        for place, p in zip(places.tolist(), posterior, strict=True):
            best = int(p.argmax())
            languages[place], scores[place] = self.languages[best], float(p[best])


def identify(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all, by default), lang_pred and score of every row, these ``named`` so.

    ``und`` with score 0 if the text is null or holds no letter, or no language
    was learned; else the likeliest language, the first by name on ties, and
    its posterior under equal priors. Columns of the input with these names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in named}]
    # The text goes to Python once, whether it is kept or not; columns go by number, as their names may be any.
    own = list(dict.fromkeys([*keep, text_col]))
    at = own.index(text_col)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    fields = [f"c{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))]

    def run(batches):
        score = vocabulary.once_per_worker(sent, Scorer)
        for batch in slices(batches):
            languages, scores = score(batch.column(at))
            arrays = [*batch.columns[: len(keep)], pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(len(keep))), "lang", "score"])

    return source.mapInArrow(run, ", ".join([*fields, "lang string", "score double"])).toDF(*keep, *named)
