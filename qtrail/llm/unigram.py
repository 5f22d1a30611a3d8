"""Unigram vocabulary of a SentencePiece file, shared by operators 3 and 6.

The file's pieces and scores are read as they are; nothing is trained.  A text
is prepared as the library does for such a file: a leading blank, blanks as
U+2581, nothing else changed.  The best segmentation has the highest sum of
scores; ties go to the path whose last piece starts earlier (the library keeps
the first best candidate of a position and tries starts in rising order).  A
character without a piece of its own costs the lowest score less 10 and becomes
its UTF-8 bytes.  Scores add up in double precision over the whole text (the
library's single precision would round sums of long texts).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, BYTE = 1, 6  # piece types of the file format


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only files with identity normalisation and a dummy prefix are read")
        #: piece -> (score, id) of what can match in a text
        self.pieces = {p.piece: (float(p.score), i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown_score = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        #: id -> the bytes it stands for
        self.raw = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif p.type == NORMAL:
                self.raw[i] = p.piece.replace(BLANK, " ").encode()
        self.longest = max(map(len, self.pieces))
        # no piece goes on with a blank after another character: every path has a
        # boundary before such a blank, so parts between them are independent
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces)
        # the same holds between a letter and a stop, and around a line feed, where no
        # piece has the two side by side
        stops = [c for c in ".,;:!?" if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", p) for p in self.pieces)]
        rules = [f"(?<=[^\\W\\d_])(?=[{re.escape(''.join(stops))}])"] if stops else []
        rules += ["(?<=\n)", "(?=\n)"] if not any("\n" in p for p in self.pieces) else []
        self._cuts = re.compile("|".join(rules) or "(?!)")
        self._beside = re.compile(f"[{re.escape(''.join(stops))}\n]")  # every cut is beside one of these
        self._parts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if apart else "(?s).+")
        self._apart = apart
        self._raw = pa.array(self.raw, pa.large_binary())

    def parts(self, text: str) -> list[str]:
        """Independent parts of a prepared text, in order."""
        if not text:
            return []
        prepared = text.replace(BLANK, " ")
        if self._apart and "  " not in prepared and prepared[0] != " " and prepared[-1] != " ":
            return list(map(BLANK.__add__, prepared.split(" ")))  # one blank before each part: no pattern is needed
        return self._parts.findall(BLANK + text.replace(" ", BLANK))

    def cuts(self, part: str) -> list[str]:
        """The parts of ``part`` that are independent by their characters."""
        if not self._beside.search(part):
            return [part]
        return [p for p in self._cuts.split(part) if p]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")

    def decode_all(self, ids: np.ndarray, sizes) -> list[str]:
        """The texts of consecutive runs of ``ids``, of ``sizes`` ids each."""
        taken = self._raw.take(pa.array(ids))  # bounds are checked; one run of bytes behind another
        ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(ids) + 1]
        ends = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)].tolist()
        raw = taken.buffers()[2].to_pybytes() if ends[-1] else b""
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:])]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
