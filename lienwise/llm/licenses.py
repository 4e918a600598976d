"""License scan by conditional compression.

A word is a run of letters and digits, so comment marks and line ends don't
count. What agrees with a template of n words to t has at most (2 - t) / t times
n words, and at least t / (2 - t) times n of them are words of the template; the
stretches of a text with so many so close together are the candidate blocks,
whatever lines or sentences they stand in.
Each block is compressed alone and with every template as a raw zstandard
dictionary. Templates that make it smaller are taken in the order of their size
reductions, and the first that the exact wording confirms wins: by the window of
the block that agrees best, with the words that it lacks and adds. Wordings that
save as much but for a few bytes, which is one version number against another,
are told apart by the words in common.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .license_texts import SPELLED, TEMPLATES

#: Levels below 13 index short dictionaries in part and can miss a whole wording of them.
LEVEL = 19
#: Size reductions so many bytes apart are equal: a literal costs its byte and up to three for its run.
CLOSE = 4
#: A shorter wording has to have its license's name, the shortest ones every word.
NAMED, WHOLE = 20, 4
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Scanner:
    """Templates (name, wording) with their words and compressors."""

    def __init__(self, templates: tuple = TEMPLATES, agree: float = 0.8) -> None:
        split = W.split_words(pa.array([text for _, text in templates], pa.large_string()), space=_OTHER)
        hashes, own = split.hashes(), range(len(templates))
        self.agree, self.names, self.words, self.needs, self.key = agree, [], [], [], []
        known: dict[int, int] = {}
        for i in own:
            a, z = split.ptr[i], split.ptr[i + 1]
            if z == a:
                continue
            for h in hashes[a:z].tolist():
                known[h] = known.get(h, 0) | 1 << len(self.names)
            self.names.append(templates[i][0])
            self.words.append([split.data[x:y].tobytes() for x, y in zip(split.starts[a:z], split.ends[a:z], strict=True)])
            parts = re.findall(r"[0-9a-z]+", templates[i][0].lower())
            named = {w.encode() for part in parts for w in (part, *SPELLED.get(part, "").split())}
            self.key.append([n for n, w in enumerate(self.words[-1]) if z - a < WHOLE or z - a < NAMED and w in named])
            self.needs.append(int(np.ceil(agree / (2 - agree) * (z - a) - 1e-9)))
        self.keys = np.array(sorted(known), np.uint64)
        self.masks = [known[int(k)] for k in self.keys]
        self.member = np.array([[m >> t & 1 for t in range(len(self.names))] for m in self.masks], bool).reshape(len(self.keys), len(self.names))
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(b" ".join(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for words in self.words]

    def blocks(self, words: W.Words) -> list[tuple[int, int]]:
        """Stretches of words, within one text each, that may hold a notice."""
        if not len(self.keys) or not len(words.starts):
            return []
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == hashes)
        place, owner = place[at], np.searchsorted(words.ptr, at, side="right") - 1
        found = []
        for t, need in enumerate(self.needs):
            own = self.member[place, t]
            mine, doc = at[own], owner[own]
            if len(mine) < need:
                continue
            longest = int(len(self.words[t]) * (2 - self.agree) / self.agree + 1e-9)
            first = np.arange(len(mine) - need + 1)
            last = first + need - 1
            first, last = (x[(mine[last] - mine[first] < longest) & (doc[last] == doc[first])] for x in (first, last))
            text = doc[first]
            low, high = np.maximum(mine[last] - longest + 1, words.ptr[text]), np.minimum(mine[first] + longest, words.ptr[text + 1])
            found += zip(low.tolist(), high.tolist(), strict=True)
        out: list[tuple[int, int]] = []
        for low, high in sorted(found):
            if out and low < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], high))
            else:
                out.append((low, high))
        return out

    def ranked(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]]]:
        """The compressed size of a block, and (bytes that its wording saves,
        template) of all templates that make it smaller, best first, ties in the
        order of the templates."""
        block = b" ".join(words)
        base = len(self.alone.compress(block))
        saved = [(base - len(c.compress(block)), i) for i, c in enumerate(self.given)]
        return base, sorted(((x, i) for x, i in saved if x > 0), key=lambda x: (-x[0], x[1]))

    def best_window(self, template: int, words: list[bytes]) -> tuple[float, int, int, list] | None:
        """(agreement, first, end, runs in common) of the window of a block
        that agrees best with a template and has the words that name it."""
        wording, key = self.words[template], self.key[template]
        runs = [r for r in difflib.SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if r.size]
        keys = [sum(r.a <= k < r.a + r.size for k in key) for r in runs]
        best = None
        for i in range(len(runs)):
            same = named = 0
            for j in range(i, len(runs)):
                same += runs[j].size
                named += keys[j]
                span = runs[j].b + runs[j].size - runs[i].b
                score = 2 * same / (len(wording) + span)
                if named == len(key) and (best is None or score > best[0]):
                    best = (score, runs[i].b, runs[j].b + runs[j].size, runs[i : j + 1])
        return best

    def notices(self, words: list[bytes]) -> list[tuple]:
        """(first, end, template, reduction, agreement, lacking, added,
        differences) of the notices of a block that don't overlap: time after
        time the one of the greatest reduction that the wording confirms."""
        out, todo = [], [(0, len(words))]
        while todo:
            low, high = todo.pop()
            if high - low < min(self.needs):
                continue
            best, least = None, 1
            base, order = self.ranked(words[low:high])
            for saved, t in order:
                if saved < least:
                    break
                if self.needs[t] > high - low:
                    continue
                window = self.best_window(t, words[low:high])
                if window and window[0] >= self.agree:
                    least = max(least, saved - CLOSE)
                    same = sum(r.size for r in window[3])
                    if best is None or (same, window[0]) > best[:2]:
                        best = (same, window[0], t, saved / base, window)
            if best is None:
                continue
            same, score, t, reduction, (_, a, z, runs) = best
            out.append((low + a, low + z, t, reduction, score, len(self.words[t]) - same, z - a - same, self._differences(t, words[low:high], runs)))
            todo += [(low, low + a), (low + z, high)]
        return sorted(out)

    def _differences(self, template: int, words: list[bytes], runs: list) -> str:
        wording, parts, a, b = self.words[template], [], 0, runs[0].b
        for r in [*runs, None]:
            lacking = wording[a : r.a if r else len(wording)]
            added = words[b : r.b] if r else []
            if lacking or added:
                parts.append(f"-{b' '.join(lacking).decode(errors='replace')} +{b' '.join(added).decode(errors='replace')}")
            if r:
                a, b = r.a + r.size, r.b + r.size
        return "; ".join(parts)


def license_notices(docs: DataFrame, templates: tuple = TEMPLATES, agree: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, place, license, reduction, agreement, words_lacking,
    words_added, differences)``: one row per notice, at its byte offset in the
    whole text. Agreement is twice the words in common, in order, over the words
    of both sides; a notice has ``agree`` or more, and of wordings of fewer than
    ``NAMED`` words the words of the license's name (spelled out or not; all words below ``WHOLE``).
    ``reduction`` is the share of the block's compressed size that the wording
    saves. Of windows that overlap the one of the greatest reduction counts;
    within ``CLOSE`` bytes of it the one with most words in common (ties: the
    higher agreement, then the greater reduction, then the earlier template).
    Null and empty texts have none, texts of any length are scanned whole;
    repeated rows repeat their notices; extra columns are ignored."""
    if not 2 / 3 <= agree <= 1:
        raise ValueError("agreement lies in [2/3, 1]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, agree)
        for b in W.pieces(batches, "t"):
            words = W.split_words(b.column("t"), space=_OTHER)
            base = np.concatenate([[0], np.cumsum(words.bytes_of)])
            rows, out = [], []
            for low, high in scanner.blocks(words):
                i = int(np.searchsorted(words.ptr, low, side="right")) - 1
                block = [words.data[x:y].tobytes() for x, y in zip(words.starts[low:high], words.ends[low:high], strict=True)]
                for first, _, t, *rest in scanner.notices(block):
                    rows.append(i)
                    out.append((int(words.starts[low + first] - base[i]), scanner.names[t], *rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([b.column("i").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["i", "place", "license", "reduction", "agreement", "words_lacking", "words_added", "differences"])

    frame = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return frame.mapInArrow(run, f"i {frame.schema['i'].dataType.simpleString()}, place long, license string, reduction double, agreement double, words_lacking long, words_added long, differences string").withColumnRenamed("i", id_col)
