"""Chroma fingerprints of audio columns, and alignment of recordings.

A recording becomes frames of twelve pitch classes (short-time spectra folded by octave, normalised).
Over the integral image of the frames, sixteen rectangle filters of a few kinds and sizes compare one
area's sum with another's; each answer is quantised to two bits, and the sixteen are packed into one
32-bit integer a frame. Recordings meet where a whole integer agrees; the offsets of those meetings
vote, and the recordings are laid over each other at the offset with most votes, where the share of
differing bits is measured. Recordings with equal fingerprints are one class, so copies meet once.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.session import materialize

RATE = 4000
FRAME, HOP = 1024, 256
WIDTH = 8
CLASSES = 12
LOWEST = 110.0
MAX_ERROR = 0.12
EDGE = 0.05

# (kind, first pitch class, pitch classes, frames): four kinds at four places and sizes.
FILTERS = [(kind, (3 * i + kind) % CLASSES, height, width)
           for kind in range(4)
           for i, (height, width) in enumerate([(3, 8), (4, 6), (6, 4), (12, 8)])]


def read_wav(data: bytes | None) -> np.ndarray:
    """Samples of a mono 16-bit WAV file, 0 to 1; null, empty or unreadable data has none."""
    if not data:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0)
            samples = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    return samples.mean(axis=1) / 32768


def melody(vector: list[float] | None, notes: int = 16, voices: int = 4) -> np.ndarray:
    """Audio of a vector: chords whose pitches follow all its values; null and empty have none.

    Shorter vectors are repeated to sixteen chords, longer ones have more.
    """
    values = np.nan_to_num(np.array([x or 0.0 for x in vector or []], float), posinf=1, neginf=-1)
    if not len(values):
        return np.zeros(0)
    notes = max(notes, -(-len(values) // voices))
    values = np.resize(values, notes * voices).reshape(notes, voices)
    pitch = np.round(18 + 24 * np.clip(values, -0.75, 0.75))
    t = np.arange(RATE // 8) / RATE
    tones = np.sin(2 * np.pi * LOWEST * 2 ** (pitch[:, :, None] / 12) * t)
    return tones.mean(axis=1).ravel()


def excerpt(vector: list[float] | None, skipped: int = 1100, noise: float = 0.02) -> np.ndarray:
    """The same melody as another recording hears it: begun later, and with noise of its own."""
    samples = melody(vector)[skipped:]
    draw = np.random.default_rng(len(samples))
    return samples + noise * draw.standard_normal(len(samples))


def _pitch_class_matrix() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), CLASSES), np.float32)
    heard = (hz >= LOWEST * 0.97) & (hz <= RATE * 0.45)
    pitch = np.round(12 * np.log2(hz[heard] / LOWEST)).astype(int) % CLASSES
    fold[np.flatnonzero(heard), pitch] = 1
    return fold


FOLD = _pitch_class_matrix()
HANN = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of pitch-class energy, each of length one; silence stays zero."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * HANN
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ FOLD
    length = np.sqrt((energy ** 2).sum(axis=1, keepdims=True))
    return energy / np.where(length > 1e-9, length, 1)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer per frame that has WIDTH frames from it on."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    # Pitch classes go round, so areas may begin anywhere.
    image = np.zeros((len(frames) + 1, 2 * CLASSES + 1))
    image[1:, 1:] = np.hstack((frames, frames)).cumsum(axis=0).cumsum(axis=1)

    def area(t: int, y: int, width: int, height: int) -> np.ndarray:
        a, b = slice(t, t + n), slice(t + width, t + width + n)
        return image[b, y + height] - image[b, y] - image[a, y + height] + image[a, y]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        whole = area(0, y, width, height)
        if kind == 0:  # earlier against later
            part = area(0, y, width // 2, height)
        elif kind == 1:  # lower against higher
            part = area(0, y, width, height // 2)
        elif kind == 2:  # two opposite quarters against the others
            w, h = width // 2, height // 2
            part = area(0, y, w, h) + area(w, y + h, width - w, height - h)
        else:  # the middle third against the rest, doubled to balance
            h = max(1, height // 3)
            part = area(0, y + h, width, h) * 1.5
        answer = np.log((0.1 + part) / (0.1 + np.maximum(whole - part, 0)))
        # Gray code, so that neighbouring levels differ in one bit.
        level = np.array([0, 1, 3, 2], np.uint32)[np.digitize(answer, [-EDGE * 8, 0.0, EDGE * 8])]
        out = (out << np.uint32(2)) | level
    return out


def fingerprints(df: DataFrame, id_col: str, audio_col: str,
                 decode: Callable[[object], np.ndarray] = read_wav) -> DataFrame:
    """(id, fp): the packed integers of every row; null, silent-short or unreadable audio has none."""
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(chroma(decode(x.as_py()))).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return df.select(id_col, audio_col).mapInArrow(run, schema)


def classes_of(prints: DataFrame, id_col: str, name: str) -> DataFrame:
    """(id, fp, copies): one row per distinct fingerprint, with the smallest id that has it."""
    return materialize(prints.where(F.size("fp") > 0).groupBy("fp").agg(
        F.min(id_col).alias("id"), F.count("*").alias("copies")), name)


def members(prints: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id): one row per recording; one without fingerprints is in no class."""
    return prints.select(F.col(id_col).alias("id"), "fp").join(
        classes.select("fp", F.col("id").alias("class_id")), "fp", "left").select("id", "class_id")


def align(queries: DataFrame, prints: DataFrame, id_col: str, max_error: float = MAX_ERROR,
          top: int | None = None) -> DataFrame:
    """The alignments of classes of query fingerprints with classes of recordings, or each one's `top` best.

    (query_id, n_copies, match_id, match_copies, offset, votes, bit_error): classes carry the smallest
    id of theirs. An offset is a frame of the recording less the query's frame laid over it.
    Alignments overlap in half of the shorter one at least. Recordings without fingerprints match
    nothing; an empty table gives an empty result.
    """
    return align_classes(classes_of(queries, id_col, "asked"), classes_of(prints, id_col, "classes"),
                         max_error, top)


def align_with_members(queries: DataFrame, prints: DataFrame, id_col: str,
                       max_error: float = MAX_ERROR) -> DataFrame:
    """Rows of three kinds: every alignment of classes, and the class of every query and recording.

    `kind` is alignment, query or recording. Alignments have the columns of `align`, the others (id,
    class_id), where class_id is a query_id for queries and a match_id for recordings.
    """
    queries, prints = materialize(queries, "query_prints"), materialize(prints, "prints")
    asked, classes = classes_of(queries, id_col, "asked"), classes_of(prints, id_col, "classes")
    out = align_classes(asked, classes, max_error).withColumn("kind", F.lit("alignment"))
    for kind, rows, of in (("query", queries, asked), ("recording", prints, classes)):
        out = out.unionByName(members(rows, of, id_col).withColumn("kind", F.lit(kind)), True)
    return out.select("kind", "id", "class_id", "query_id", "n_copies", "match_id", "match_copies",
                      "offset", "votes", "bit_error")


def align_classes(asked: DataFrame, classes: DataFrame, max_error: float = MAX_ERROR,
                  top: int | None = None) -> DataFrame:
    """`align` for the rows of `classes_of`."""
    probes = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    probed = asked.select(F.col("id").alias("q"), F.posexplode("fp").alias("qt", "_s")).select(
        "q", "qt", F.explode(F.transform(probes, lambda x: F.col("_s").bitwiseXOR(x))).alias("sub"))
    # Probes are many times their table's size, by which Spark would choose to broadcast them.
    votes = probed.hint("merge").join(
        classes.select("id", F.posexplode("fp").alias("at", "sub")), "sub").groupBy(
        "q", "id", (F.col("at") - F.col("qt")).alias("offset")).agg(F.count("*").alias("votes"))
    a = asked.select(F.col("id").alias("q"), F.col("fp").alias("a"), F.col("copies").alias("n_copies"))
    b = classes.select("id", F.col("fp").alias("b"), F.col("copies").alias("match_copies"))
    laid = votes.join(a, "q").join(b, "id").withColumn(
        "_a", F.expr("slice(a, greatest(1 - offset, 1), size(a))")).withColumn(
        "_b", F.expr("slice(b, greatest(1 + offset, 1), size(b))")).withColumn(
        "_n", F.least(F.size("_a"), F.size("_b")))
    bits = F.expr("aggregate(zip_with(slice(_a, 1, _n), slice(_b, 1, _n), "
                  "(x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    measured = laid.where("2 * _n >= least(size(a), size(b))").withColumn(
        "bit_error", bits / (32 * F.col("_n"))).where(F.col("bit_error") <= max_error)
    # Of a pair's offsets the one with the fewest bit errors stays, which votes alone may not name.
    rest = ("votes", "n_copies", "match_copies")
    measured = measured.groupBy("q", "id").agg(F.min_by(F.struct("offset", "bit_error", *rest), F.struct(
        "bit_error", (-F.col("votes")).alias("_v"), F.abs("offset").alias("_near"), "offset")).alias("m")) \
        .select("q", "id", "m.*")
    if top is not None:
        order = Window.partitionBy("q").orderBy("bit_error", F.desc("votes"), "id")
        measured = measured.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return measured.select(
        F.col("q").alias("query_id"), "n_copies", F.col("id").alias("match_id"), "match_copies",
        "offset", "votes", "bit_error")
