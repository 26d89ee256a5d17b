"""Line dedup by winnowing.

Texts are sequences of words; a line is LINE words in a row, starting at any word, so that a passage is found wherever
the writer broke it. Of the lines of every run of `least` words the one with the least hash is selected as its
fingerprint (the last of equals): equal runs select the same line at the same place, so texts that share a run share a fingerprint for certain.

A fingerprint stands for all runs that select it, and its stretch is what these cover: the match of the line, extended
both ways. Fingerprints that occur at two places are compared by their stretches: a stretch that has an earlier place (smaller
id, then smaller position) is deleted whole. Of each different stretch the first is taken apart into its runs, if another
stretch shares the words on one side of the line: every such run looks up its own first place by its hash. So exactly those
words are deleted that belong to a run of `least` words with an earlier place, whichever place that is. Where a run overlaps its own
first place in the same text, that place keeps its words.

Lines as written, closed by line ends, are fingerprints of their own if they have `line` words or more (and fewer than `least`): all but the
first of equal ones are deleted.

Common lines, stretches and runs are joined where they lie (see common.meet), and only texts that a sketch can't rule out are shuffled.

Defined results: null texts stay null, empty texts and texts of fewer words than `line` stay as they are; rows that repeat both id and
text are treated alike, so none deletes the other; null ids come last; equal ids go by a hash of the text; a text that is deleted whole
is ''. Exact copies are runs like any other: those of `least` words are deleted whole. All other columns, whatever their names, pass through. Equal
64-bit hashes count as equal words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, meet, range_hashes, release, sketch, slices, small_batches, with_sketch, word_ranges, written

#: Words of a line that is hashed, of a run that is deleted, and of a written line that is deleted.
LINE, LEAST, WRITTEN = 10, 50, 10
RUNS = "array<struct<start:int,end:int>>"
NO_RUNS = f"cast(array() as {RUNS})"

MARK = pa.struct([("h", pa.int64()), ("stretch", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("cut", pa.int32())])
MARKS = "array<struct<h:bigint,stretch:bigint,start:int,end:int,left:bigint,right:bigint,cut:int>>"
#: Keep apart the hashes of words that stand for different things.
LEFT, RIGHT, OWN_LINE = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D))


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of successive hashes the place of its least, the last of equals."""
    places = np.arange(len(hashes))
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = places[:-step], places[step:]
        places = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return places


def fingerprints(words: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The text and the marks of each fingerprint, from the word hashes of concatenated texts and the words before each text.

    h: the line. stretch, start, end: hash and words of the runs that select it. cut: runs that start there or before have half of their other words or more before
    the line. left, right: hash of what these runs have in common, and of what the others have; 0 if there are none.
    """
    counts = np.diff(before)
    lines = np.maximum(counts - LINE + 1, 0) * (counts >= least)
    text = np.repeat(np.arange(len(lines)), lines)
    if not len(text):
        return np.zeros(0, np.int64), {f.name: np.zeros(0, np.int64) for f in MARK}
    at = before[text] + np.arange(len(text)) - np.concatenate([[0], np.cumsum(lines)])[text]
    window = least - LINE + 1
    hashes = range_hashes(words, at, at + LINE)
    minima = window_minima(hashes, window)
    whole = np.flatnonzero(text[: len(minima)] == text[window - 1 :])
    chosen, first, many = np.unique(minima[whole], return_index=True, return_counts=True)
    line, start = at[chosen], at[whole[first]]
    end, half = start + many - 1 + least, (least - LINE) // 2
    has_left, has_right = start <= line - half, end - least > line - half
    ends = [end, np.where(has_left, line + LINE, start), np.where(has_right, line - half + 1 + least, line)]
    starts = [start, np.where(has_left, line - half, start), line]
    stretch, left, right = np.split(range_hashes(words, np.concatenate(starts), np.concatenate(ends)), 3)
    origin = before[text[chosen]]
    return text[chosen], {
        "h": hashes[chosen].view(np.int64), "stretch": stretch.view(np.int64), "start": start - origin, "end": end - origin,
        "left": np.where(has_left, left ^ LEFT, 0).astype(np.uint64).view(np.int64), "right": np.where(has_right, right ^ RIGHT, 0).astype(np.uint64).view(np.int64), "cut": line - half - origin,
    }


def written_lines(data: np.ndarray, starts: np.ndarray, words: np.ndarray, before: np.ndarray, line: int, least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The text and the marks of each line as written of `line` words or more, and fewer than `least`."""
    number = np.searchsorted(np.flatnonzero(data == 10), starts)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(starts))
    kept = (end - start >= line) & (end - start < least)
    start, end = start[kept], end[kept]
    h = (range_hashes(words, start, end) ^ OWN_LINE).view(np.int64)
    origin, none = before[text[start]], np.zeros(len(start), np.int64)
    return text[start], {"h": h, "stretch": h, "start": start - origin, "end": end - origin, "left": none, "right": none, "cut": none}


def _marks(line: int, least: int):
    @arrow(MARKS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, number = [], [0]
            for _, data, offsets in slices(batch):
                starts, ends, before = word_ranges(data, offsets)
                words = range_hashes(data, starts, ends)
                pairs = [fingerprints(words, before, least), written_lines(data, starts, words, before, line, least)]
                text = np.concatenate([t for t, _ in pairs])
                order = np.argsort(text, kind="stable")
                found.append([np.concatenate([m[f.name] for _, m in pairs])[order] for f in MARK])
                number.extend((number[-1] + np.cumsum(np.bincount(text, minlength=len(offsets) - 1))).tolist())
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]), pa.int64()).cast(f.type) for k, f in enumerate(MARK)]
            yield pa.ListArray.from_arrays(pa.array(number, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(MARK)))
        release()

    return of


def flat(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's structs of two numbers begin and end among all of them, and these two numbers."""
    number = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return number, [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten()]


def covered_words(first: int, before: np.ndarray, number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word of concatenated texts, the first of which is row `first`, whether a span of its row (starts and ends as flat() gives them) covers it."""
    of = slice(number[first], number[first + len(before) - 1])
    origin = np.repeat(before[:-1], np.diff(number[first : first + len(before)]))
    start, end = origin + starts[of], origin + ends[of]
    some = start < end
    edges = np.bincount(start[some], minlength=before[-1] + 1) - np.bincount(end[some], minlength=before[-1] + 1)
    return np.cumsum(edges)[:-1] > 0


def _run_hashes(least: int):
    """(start, key) of the runs of `least` words that start within the wanted ranges."""

    @arrow("array<struct<start:int,key:bigint>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted in batches:
            (number, (low, high)), many, starts_, keys = flat(wanted), [0], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, data, offsets in slices(texts):
                starts, ends, before = word_ranges(data, offsets)
                at = np.flatnonzero(covered_words(first, before, number, low, high + 1))
                counts = np.diff(np.searchsorted(at, before))
                keys.append(range_hashes(range_hashes(data, starts, ends), at, at + least))
                starts_.append(at - np.repeat(before[:-1], counts))
                many.extend((many[-1] + np.cumsum(counts)).tolist())
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(starts_), pa.int64()).cast(pa.int32()), pa.array(np.concatenate(keys).view(np.int64))], names=["start", "key"])
            yield pa.ListArray.from_arrays(pa.array(many, pa.int32()), values)
        release()

    return of


def without(first: int, data: np.ndarray, offsets: np.ndarray, number: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What is left of concatenated texts without the words of their rows' spans: bytes, and bytes of each text; the runs of each text, their starts and ends; the words of each text."""
    starts, _, before = word_ranges(data, offsets)
    gone = covered_words(first, before, number, *spans)
    edge = np.zeros(len(gone) + 1, bool)
    edge[before] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
    end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
    text = np.searchsorted(before, begin, "right") - 1
    low, high = starts[begin], np.where(end == before[text + 1], offsets[text + 1], np.append(starts, 0)[end])
    steps = np.zeros(len(data) + 1, np.int8)
    steps[low] += 1
    steps[high] -= 1
    left = data[np.cumsum(steps, dtype=np.int8)[:-1] == 0]
    runs = np.bincount(text, minlength=len(offsets) - 1)
    sizes = np.diff(offsets) - np.bincount(text, high - low, minlength=len(offsets) - 1).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    blank = [k for k in np.flatnonzero((runs > 0) & (sizes > 0)) if not left[at[k] : at[k + 1]].tobytes().decode(errors="replace").strip()]
    if blank:
        left, sizes[blank] = left[~np.repeat(np.isin(np.arange(len(sizes)), blank), sizes)], 0
    return left, sizes, [runs, begin - before[text], end - before[text], np.diff(before)]


@arrow(f"struct<text:string,runs:{RUNS},words:bigint>", once=True)
def _delete(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without its repeated runs, these runs, and how many words it had."""
    for texts, found in batches:
        number, spans = flat(found)
        parts = [without(first, data, offsets, number, spans) for first, data, offsets in slices(texts)]
        none = np.zeros(0, np.int64)
        sizes, (runs, start, end, words) = np.concatenate([none, *(p[1] for p in parts)]), [np.concatenate([none, *(p[2][k] for p in parts)]) for k in range(4)]
        left = np.concatenate([np.zeros(0, np.uint8), *(p[0] for p in parts)])
        clean = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(left)]).cast(pa.string())
        if texts.null_count:
            clean = pc.if_else(texts.is_valid(), clean, pa.scalar(None, pa.string()))
        places = pa.StructArray.from_arrays([pa.array(x, pa.int64()).cast(pa.int32()) for x in (start, end)], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int64()).cast(pa.int32()), places)
        yield pa.StructArray.from_arrays([clean, lists, pa.array(words, pa.int64())], names=["text", "runs", "words"])
    release()


@arrow("bigint")
def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many words a text has."""
    for texts in batches:
        yield pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(word_ranges(data, offsets)[2]) for _, data, offsets in slices(texts))]), pa.int64())
    release()


def _place():
    """Where something stands, in the order in which the first place is kept."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "th", "start")


def _places_of(places: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that occur at two places or more, and their rows."""
    place = F.xxhash64("id", "th", "start")
    return places.groupBy(key).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select(key, "n")


def _later(met: DataFrame, length) -> DataFrame:
    """(id, th, start, end) of the places in `met` that have an earlier one, `at`; what overlaps that place in its own text begins after its first `length` words."""
    same_text = F.col("id").eqNullSafe(F.col("at.id")) & (F.col("th") == F.col("at.th"))
    begin = F.when(same_text, F.greatest("start", F.col("at.start") + length)).otherwise(F.col("start"))
    return met.where(~(same_text & (F.col("start") == F.col("at.start")))).select("id", "th", begin.alias("start"), "end").where("start < end")


def find_repeats(keyed: DataFrame, text, line: int, least: int) -> DataFrame:
    """(id, th, start, end): the spans of words that have an earlier place. keyed: id, th and what `text` needs."""
    marks = written(keyed.select("id", "th", F.explode(_marks(line, least)(text)).alias("m")).select("id", "th", "m.*"), "h", "stretch", "left", "right")
    again = written(_places_of(marks, "h"))
    marks = written(meet(marks, again, "h", marks.count()).select(*marks.columns))

    payload = F.struct(F.col("id").isNull().alias("none"), "id", "th", "start", "end", "left", "right", "cut")
    place = F.xxhash64("id", "th", "start")
    firsts = written(marks.groupBy("stretch").agg(F.min(payload).alias("at"), F.count("*").alias("n"), (F.min(place) != F.max(place)).alias("more")))
    met = meet(marks.select("stretch", "id", "th", "start", "end"), firsts.where("more").select("stretch", "n", F.struct("at.id", "at.th", "at.start").alias("at")), "stretch", marks.count())
    found = _later(met, F.least(F.lit(least), F.col("end") - F.col("start")))

    last, cut = F.col("at.end") - least, F.col("at.cut")
    left = F.struct(F.col("at.left").alias("side"), F.col("at.start").alias("from"), F.least(last, cut).alias("to"))
    right = F.struct(F.col("at.right").alias("side"), F.greatest(F.col("at.start"), cut + 1).alias("from"), last.alias("to"))
    sides = written(firsts.select("stretch", "at.id", "at.th", F.explode(F.array(left, right)).alias("s")).where("s.side != 0").select("stretch", "id", "th", "s.*"))
    shared = written(sides.groupBy("side").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b"), F.count("*").alias("n")).where("a != b").select("side", "n"))
    wanted = written(meet(sides, shared, "side", sides.count()).groupBy("id", "th").agg(F.collect_list(F.struct("from", "to")).alias("wanted")))

    runs = _held(keyed, wanted).select("id", "th", F.explode(_run_hashes(least)(text, F.col("wanted"))).alias("r")).select("id", "th", "r.start", (F.col("r.start") + least).alias("end"), "r.key")
    runs = written(runs, "key")
    known = written(runs.groupBy("key").agg(F.min(_place()).alias("at"), F.count("*").alias("n")).where("n > 1"))
    return found.unionByName(_later(meet(runs, known, "key", runs.count()), F.lit(least)))


def _key():
    return F.xxhash64("id", "th")


def _held(keyed: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of keyed that have a row in `of` (id, th and more), with it; only those that its sketch doesn't rule out are shuffled."""
    near = with_sketch(keyed, _key(), sketch(of, _key()), "held").where("held").drop("held")
    more = of.withColumnsRenamed({"id": "of_id", "th": "of_th"})
    return near.join(more, near["id"].eqNullSafe(more["of_id"]) & (near["th"] == more["of_th"])).drop("of_id", "of_th")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line: int = WRITTEN, least: int = LEAST) -> DataFrame:
    """(row, clean): row holds all columns of docs; clean is struct(text, runs, words), the text without later repeats, the deleted runs of words, and how many words it had."""
    if least < 2 * LINE:
        raise ValueError(f"runs have {2 * LINE} words at least")
    small_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col].cast("string")).alias("th"))
    text = F.col("row")[text_col].cast("string")
    spans = written(find_repeats(keyed, text, line, least).groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    marked = with_sketch(keyed, _key(), sketch(spans, _key()), "held")
    more = spans.withColumnsRenamed({"id": "of_id", "th": "of_th"})
    near = marked.where("held").join(more, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")), "left")
    changed = near.select("row", _delete(text, F.coalesce("spans", F.expr(NO_RUNS))).alias("clean"))
    whole = marked.where("NOT held").select("row", F.struct(text.alias("text"), F.expr(NO_RUNS).alias("runs"), _words(text).alias("words")).alias("clean"))
    return whole.unionByName(changed)
