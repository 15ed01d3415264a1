"""License scans: fuzzy search for short notices.

Texts become words (A-Z lower-cased, runs of characters outside ASCII punctuation and white space). A notice may differ
from a place in the text by some single-character edits: cut into one more piece than edits are allowed, at least one
piece is there unchanged (pigeonhole). Pieces are sought exactly; only windows around them go to the regex library, whose
bounded-error matching counts the edits and gives the span. Phrases of the base contract are sought exactly.

Defined cases: null and empty texts have no words, no labels and score 0; overlapping windows of one notice are searched
as one, so repeated pieces cost no more than the text is long; repeated rows are scanned each; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import table, utf8_bytes

#: The phrases and labels of the base contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (notice, label, allowed edits).
NOTICES = [
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("you may not use this file except in compliance with the license", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 3),
    ("this program is free software you can redistribute it and or modify", "gpl", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("creative commons attribution", "cc", 2),
    ("mozilla public license", "mpl", 1),
    ("spdx license identifier", "spdx", 1),
    ("all rights reserved", "reserved", 1),
]
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPANS = "array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:int>>"


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece): the notice cut into edits + 1 parts of about equal length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


class Notice:
    def __init__(self, notice: str, label: str, edits: int):
        self.notice, self.label, self.edits, self.length = notice, label, edits, len(notice)
        self.pieces = pieces(notice, edits)
        pattern = b" (?:%s){e<=%d} " % (regex.escape(notice.encode()), edits)
        self.pattern, self.first = regex.compile(b"(?b)" + pattern), regex.compile(pattern)

    def windows(self, text: bytes) -> list[list[int]]:
        """Merged stretches of the text that can hold a match around an exact piece."""
        spans = []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                spans.append((max(0, at - offset - self.edits - 1), min(len(text), at - offset + self.length + self.edits + 2)))
                at = text.find(piece, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return merged

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """Matches of every window that share no word: the one with the fewest edits among those that overlap goes first."""
        for a, b in self.windows(text):
            left = [(a, b)]
            while left:
                a, b = left.pop()
                m = self.first.search(text, a, b)
                if m is None:
                    continue
                # The best match near the first one, until none that overlaps it has fewer edits; nothing starts before the first.
                start, edits = m.start(), sum(m.fuzzy_counts) + 1
                while sum(m.fuzzy_counts) < edits:
                    edits, near = sum(m.fuzzy_counts), self.length + self.edits + 1
                    m = self.pattern.search(text, max(start, m.start() - near), min(b, m.end() + near)) or m
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                # A space may end one match and begin the next.
                left.append((m.end() - 1, b))
                if m.start() > start:
                    left.append((start, m.start() + 1))


def scan_text(text: str | None, notices: list[Notice]) -> dict:
    words = utf8_bytes(text).translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    spaces: list[np.ndarray] = []

    def word_at(pos: int) -> int:
        """Number of the word that starts behind the space at pos; the places of spaces are found once, if anything is."""
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32))
        return int(np.searchsorted(spaces[0], pos))

    places, base, score = [], set(), 0.0
    for phrase, label in BASE.items():
        needle = b" %s " % phrase.encode()
        at = line.find(needle)
        while at >= 0:
            places.append(word_at(at))
            base.add(label)
            at = line.find(needle, at + 1)
    spans = []
    for n in notices:
        for a, b, edits in sorted(n.matches(line)):
            spans.append({"label": n.label, "notice": n.notice, "first_word": word_at(a), "last_word": word_at(b - 1) - 1, "edits": edits})
            score = max(score, 1 - edits / n.length)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})), "score": 1.0 if places else score, "spans": spans,
    }


def license_scan(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """One row per input row: doc_id, counts, labels, score and the spans of fuzzy matches with their edits."""
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Notice(*n) for n in notices]
        for batch in batches:
            found = [scan_text(t, compiled) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
