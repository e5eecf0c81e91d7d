"""Fill-in-the-middle transformation of documents, cut at lines, by a table-driven automaton over bytes.

Texts lie side by side in lanes of a fixed number of bytes; a lane holds one text only, and all lanes
step through the automaton together. It knows whether a unit has begun and how much of a sentinel it
has seen; for each transition a second table has what to count: code points (continuation bytes have
none), units begun, sentinels met. Two bytes decide the automaton's state whatever it was before, so a
lane begins with the last two bytes of the lane before it; this is checked when the tables are made.

The first pass counts the transitions of each lane. Counts of lanes give those of texts, and the
lanes in which the units after the two cuts begin. The second pass steps through these lanes only and
notes the byte at which that unit begins and the code points before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import hide, map_arrow
from .words import by_bytes

#: Fixed values of the format: sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, FIM_RATE, SPM_RATE = 7, 100, 50
LANE, LANES = 128, 8192  #: bytes in a lane, lanes that step together

#: States: before a unit; in a unit; in a unit after "<"; after "<" and a letter of a sentinel.
_BEFORE, _IN, _OPEN, _LETTER = range(4)
#: Places of the three counts in a transition's number; a lane's bytes can't overflow them.
_POINT, _UNIT, _SENTINEL = 0, 10, 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, counts) of each state * 256 + byte."""
    after, counts = np.zeros((4, 256), np.uint16), np.zeros((4, 256), np.int32)
    for state in range(4):
        for byte in range(256):
            continues = 0x80 <= byte < 0xC0
            counts[state, byte] = (not continues) << _POINT | (state == _BEFORE) << _UNIT
            if byte == ord("\n"):
                after[state, byte] = _BEFORE
            elif byte == ord("<"):
                after[state, byte] = _OPEN
            elif state == _OPEN and byte in b"PSM":
                after[state, byte] = _LETTER
            else:
                after[state, byte] = _IN
                counts[state, byte] |= (state == _LETTER and byte == ord(">")) << _SENTINEL
    one = after[:, :, None].repeat(256, 2)  # two bytes on, by any first and second byte
    two = after[one, np.arange(256)[None, None, :]]
    if (two != two[:1]).any():
        raise ValueError("two bytes must decide the state")
    return after.ravel(), counts.ravel()


_AFTER, _COUNTS = _tables()


def _lanes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, text) of each lane of the texts data[offsets[t]:offsets[t + 1]]."""
    size = np.diff(offsets)
    n = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), n)
    first = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * LANE
    return first, np.minimum(offsets[1:][text] - first, LANE), text


def _steps(data: np.ndarray, begin: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The counts of each step's transitions in all these lanes; begin: first bytes of the lanes' texts."""
    at = first[:, None] + np.arange(-2, LANE)[None, :]
    inside = (at >= begin[:, None]) & (at < (first + size)[:, None])
    block = np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).T.copy()
    inside = inside.T.copy()
    state = np.zeros(len(first), np.uint16)
    for k in range(LANE + 2):
        key = state << 8 | block[k]
        if k >= 2:
            yield k - 2, np.where(inside[k], _COUNTS[key], 0)
        state = np.where(inside[k], _AFTER[key], state)


def scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[lane, (code points, units begun, sentinels)] of all lanes: the first pass."""
    first, size, text = _lanes(data, offsets)
    out = np.zeros((len(first), 3), np.int64)
    for lo in range(0, len(first), LANES):
        part = slice(lo, lo + LANES)
        total = np.zeros(len(first[part]), np.int64)
        for _, counts in _steps(data, offsets[text[part]], first[part], size[part]):
            total += counts
        out[part] = np.stack([total >> _POINT & 1023, total >> _UNIT & 1023, total >> _SENTINEL], 1)
    return out


def locate(data: np.ndarray, offsets: np.ndarray, lanes: np.ndarray, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, code points) of these texts before the unit of each number (from 0): the second pass. The last number is a text's end."""
    size = np.diff(offsets)
    first, lane_size, owner = _lanes(data, offsets)
    start = np.searchsorted(owner, np.arange(len(size) + 1))
    before = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(lanes, 0)])
    of_text = before[start[1:]] - before[start[:-1]]
    n_bytes, n_points = size[text].copy(), of_text[text, 0].copy()
    for lo in range(0, len(text), LANES):
        some = lo + np.flatnonzero(units[lo : lo + LANES] < of_text[text[lo : lo + LANES], 1])
        if not len(some):
            continue
        wanted = before[start[text[some]], 1] + units[some]  # units begun in all lanes before it
        lane = np.searchsorted(before[1:, 1], wanted, side="right")
        rest = wanted - before[lane, 1]
        seen, points, found = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.zeros(len(some), bool)
        for k, counts in _steps(data, offsets[text[some]], first[lane], lane_size[lane]):
            begun = counts >> _UNIT & 1
            new = ~found & (begun == 1) & (seen == rest)
            n_bytes[some[new]] = first[lane[new]] + k - offsets[text[some[new]]]
            n_points[some[new]] = before[lane[new], 0] - before[start[text[some[new]]], 0] + points[new]
            found |= new
            seen += begun
            points += counts >> _POINT & 1
    return n_bytes, n_points


def restored(output: bytes, form: str) -> bytes:
    """The text of an output of this form."""
    if form == "plain":
        return output
    a, b = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    cut = output.index(b, len(a))
    mid = output.index(MIDDLE, cut + len(b))
    one, two, middle = output[len(a) : cut], output[cut + len(b) : mid], output[mid + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED, digest: bool = False) -> DataFrame:
    """All columns of ``docs`` and _n (units), _form, _prefix_chars, _middle_chars, _output, _restored; as SHA-256 of the last two if ``digest``, without text.

    Units are lines with their line feeds. A document's choices come from the SHA-256 of the seed and its
    doc_id, so equal doc_ids are cut by the same numbers; a null doc_id is written as nothing. A null or
    empty text is an empty one, and plain; so is a text with a sentinel in it. _prefix_chars and
    _middle_chars are null if plain. Rows are taken one by one, repeated ones too; an empty table gives
    an empty result. Other columns pass through, and one of a name that is added is replaced.
    """
    slim, back = hide(docs, "doc_id", "text")
    own = [T.StructField(n, t) for n, t in (("_n", T.LongType()), ("_form", T.StringType()), ("_prefix_chars", T.LongType()), ("_middle_chars", T.LongType()), ("_output", T.StringType()), ("_restored", T.StringType()))]
    names = [c for c in slim.columns if not (digest and c == "text")]
    id_at, text_at, stay = slim.columns.index("doc_id"), slim.columns.index("text"), [slim.columns.index(c) for c in names]
    titles = names + [f.name for f in own]

    def shown(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest() if digest else x.decode("utf-8", "replace")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_at):
                texts = [x or b"" for x in part.column(text_at).cast(pa.large_binary()).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                lanes = scan(data, offsets)
                owner = np.searchsorted(_lanes(data, offsets)[2], np.arange(len(texts) + 1))
                sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(lanes, 0)])
                n_units, met = ((sums[owner[1:]] - sums[owner[:-1]])[:, k] for k in (1, 2))
                some, cuts, spm = [], [], {}
                for t, doc_id in enumerate(part.column(id_at).to_pylist()):
                    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
                    if texts[t] and not met[t] and h3 % 100 < fim_rate:
                        n = int(n_units[t]) + 1
                        spm[t] = h4 % 100 < spm_rate
                        some += [t, t]
                        cuts += sorted((h1 % n, h2 % n))
                at, points = locate(data, offsets, lanes, np.array(some, np.int64), np.array(cuts, np.int64))
                form, prefix, middle, output, again, k = [], [], [], [], [], 0
                for t, text in enumerate(texts):
                    if t in spm:
                        a, b = int(at[k]), int(at[k + 1])
                        made = SUFFIX + text[b:] + PREFIX + text[:a] if spm[t] else PREFIX + text[:a] + SUFFIX + text[b:]
                        made += MIDDLE + text[a:b]
                        form.append("spm" if spm[t] else "psm")
                        prefix.append(int(points[k]))
                        middle.append(int(points[k + 1] - points[k]))
                        k += 2
                    else:
                        made = text
                        form.append("plain")
                        prefix.append(None)
                        middle.append(None)
                    output.append(shown(made))
                    again.append(shown(restored(made, form[-1])))
                more = [pa.array(n_units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()), pa.array(again, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in stay] + more, titles)

    out = map_arrow(slim, cut, T.StructType([f for f in slim.schema.fields if f.name in names] + own))
    return back(out, *[f.name for f in own], without=("text",) if digest else ())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
    return out.selectExpr("doc_id", "_n AS n", "_form AS form", "_prefix_chars AS prefix_chars", "_middle_chars AS middle_chars", "_output AS output_sha256", "_restored AS restored_sha256")


#: Lines as lists, and the parts as joined ranges of them.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || COALESCE(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, COALESCE(array_to_string(u[1:a], ''), '') AS pre, COALESCE(array_to_string(u[a + 1:b], ''), '') AS mid, COALESCE(array_to_string(u[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
