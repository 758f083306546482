"""Operator 6: licence scans by TF-IDF cosine to templates, with inheritance from the nearest ancestor directory.

Templates are statements, standard headers, titles, whole short licences and the openings of long ones, each a sparse TF-IDF vector over words; the document
frequencies of the templates' words are counted over the whole corpus. Of a file with a licence cue these stretches become vectors, over line breaks and
comment signs: around each cue with so many words before and after, each paragraph that holds a cue, the beginnings of the file, and the whole file. All
stretches of a batch meet all templates in matrix products, the cues so many at a time. As a vector knows no order, a stretch counts only if more than ORDER of
its neighbouring words are neighbours in its template, too, and if no negation stands before it in its sentence, NEAR words away at most. A title at the beginning names a licence file's licence (its text quotes other
licences); else the best stretch above the threshold is the file's own licence. A licence file, by its name or because
statements make up a good part of it, sets the licence of its directory; files without a licence of their own inherit from the nearest
directory above them that has one.

Inheritance joins directories, not files: each distinct directory meets its ancestors, and files then look up their own directory,
so an ancestor that a third of all files share enters the join once for each directory below it. Texts are never shuffled.

Defined cases: a null or empty text has no licence of its own. A null path is the root directory. Of equal scores the stretch that begins first
counts, then the licence that comes first by name (so a GNU licence without a version is its first version); of several licence files in a directory the one
with the best score. Repeated rows get equal results. A very long text is scored whole, in one task; bytes that aren't UTF-8 are letters.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import ALNUM_OR_WIDE, CHUNK_BYTES, LOWER, Scratch, chunks, frugal, input_bytes, measured_side, member, mix, salted_join, text_buffer, word_hashes, words

#: Licences and what statements call them.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "Artistic-1.0": ("Artistic License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication", "CC0 1.0"),
    "CDDL-1.0": ("Common Development and Distribution License, Version 1.0",),
    "EPL-1.0": ("Eclipse Public License, Version 1.0",),
    "EPL-2.0": ("Eclipse Public License, Version 2.0",),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "GPL-1.0": ("GNU General Public License, version 1",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "ISC": ("ISC License",),
    "LGPL-2.0": ("GNU Library General Public License, version 2",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-1.1": ("Mozilla Public License, Version 1.1",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("zlib License",),
}
#: How statements put these names.
FORMS = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This file is subject to the terms of the {}", "Distributed under the terms of the {}")
#: Titles at the beginning of a licence's text.
TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Artistic-1.0", 'The "Artistic License" Preamble'),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Headers of the GNU licences, by name and version.
GNU = (("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", ("2",)), ("AGPL", "Affero General", ("3",)))
GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; "
    "either version {} of the License, or (at your option) any later version."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_2 = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
#: Other statements, headers and texts.
TEXTS = (
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", _BSD + _BSD_2),
    ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3),
    ("BSD-3-Clause", _BSD_3),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright, CC0 1.0 public domain dedication"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def templates() -> tuple[tuple[str, str, bool], ...]:
    """(licence, text, whether it is a title), by licence."""
    out = [(name, text, True) for name, text in TITLES] + [(name, text, False) for name, text in TEXTS]
    for name, called in NAMES.items():
        out += [(name, form.format(x), False) for x in called for form in FORMS]
        out += [(name, f"SPDX-License-Identifier: {name}{end}", False) for end in (("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",))]
    out += [(f"{short}-{v if '.' in v else v + '.0'}", GNU_HEADER.format(long, v), False) for short, long, versions in GNU for v in versions]
    return tuple(sorted(set(out)))


#: Licences whose text is part of a longer one's, which counts where its own clause is found.
YIELDS = {"BSD-2-Clause": ("BSD-3-Clause", _BSD_3)}
THRESHOLD = 0.6
#: From which a beginning counts as a title.
TITLE_THRESHOLD = 0.8
#: Share of a file's words in statements from which it counts as a licence file whatever its name.
FILE_SHARE = 0.3
#: Words before a cue and from it on, and words of a file's beginning.
BEFORE, AFTER, HEADS = (0, 1, 2, 4, 8, 16, 32), (3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 40, 64), (3, 5, 7, 9, 12, 16, 24)
#: Share of neighbouring words that a stretch must have in common with its template, and words within which a negation speaks about what follows.
ORDER, NEAR = 0.5, 6
#: Words of templates that must be there in full, and of templates that are one statement.
BRIEF, STATEMENT = 3, 24
#: Words that say that something doesn't hold.
NEGATIONS = ("not", "never", "nor", "neither", "without", "isn", "aren", "cannot")
#: Cues whose stretches are scored at once.
CUES_AT_ONCE = 2048
#: Words of stretches that are scored at once.
SCORED = 1 << 19
CUES = "license licence licensed licences licenses unlicense copyright copyrighted rights domain permission permitted redistribution redistributions redistribute spdx waived mit isc bsd gpl gnu".split()

_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
_SENTENCE = re.compile(rb"[.!?;:][ \t\r\n]|\n[ \t\r*#/;%!>-]*\n")
_BREAK = re.compile(rb"\n[ \t\r*#/;%!>-]*\n")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


_STEP = np.uint64(0xD1342543DE82EF95)


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


TEMPLATES = templates()
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in terms(t)})


def _hashes(texts: list[str]) -> np.ndarray:
    raw = [w.encode() for w in texts]
    ends = np.cumsum([len(x) for x in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def _pair(a: np.ndarray, b: np.ndarray, template) -> np.ndarray:
    """A hash of two neighbouring words and a template's number."""
    return mix(mix(a * _STEP + b) + np.asarray(template).astype(np.uint64))


class Scorer:
    """Cosine of stretches of text to every template. frequency: in how many of n documents each word of the vocabulary stands."""

    def __init__(self, frequency: dict[str, int], n: int):
        keys = _hashes(VOCABULARY)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.idf = np.array([log((1 + n) / (1 + frequency.get(VOCABULARY[k], 0))) + 1 for k in order.tolist()])
        self.unknown = log(1 + n) + 1
        self.cues = np.sort(_hashes(CUES))
        self.negations = np.sort(_hashes(list(NEGATIONS)))
        self.names = np.array([name for name, _, _ in TEMPLATES])
        self.length = np.array([len(terms(text)) for _, text, _ in TEMPLATES])
        self.plain = np.array([len(terms(text)) <= STATEMENT and not set(NEGATIONS) & set(terms(text)) for _, text, _ in TEMPLATES])
        self.pairs = np.unique(np.concatenate([_pair(h[:-1], h[1:], j) for j, (_, text, _) in enumerate(TEMPLATES) for h in (_hashes(terms(text)),)]))
        self.title = np.array([title for _, _, title in TEMPLATES])
        self.yields = {name: (longer, np.array([text == clause for _, text, _ in TEMPLATES])) for name, (longer, clause) in YIELDS.items()}
        place = {VOCABULARY[k]: i for i, k in enumerate(order.tolist())}
        matrix = np.zeros((len(self.keys), len(TEMPLATES)))
        for j, (_, text, _) in enumerate(TEMPLATES):
            for w in terms(text):
                matrix[place[w], j] += self.idf[place[w]]
        self.matrix = matrix / np.sqrt((matrix**2).sum(0))

    def scores(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of words (lo to hi): the best score and its template, over all templates and over titles."""
        out = [np.zeros(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo)), np.zeros(len(lo), np.int64)]
        size = hi - lo
        total = np.concatenate([[0], np.cumsum(size)])
        titles = np.flatnonzero(self.title)
        i = 0
        while i < len(lo):
            j = min(max(i + 1, int(np.searchsorted(total, total[i] + SCORED, side="right")) - 1), i + 4096, len(lo))
            mine = size[i:j]
            unit = np.repeat(np.arange(j - i), mine)
            x = h[np.repeat(lo[i:j] - (total[i:j] - total[i]), mine) + np.arange(len(unit))]
            order = np.lexsort([x, unit])
            unit, x = unit[order], x[order]
            new = np.ones(len(x), bool)
            new[1:] = (unit[1:] != unit[:-1]) | (x[1:] != x[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(x)))
            unit, x = unit[begin], x[begin]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            known = self.keys[at] == x
            weight = times * np.where(known, self.idf[at], self.unknown)
            norm = np.sqrt(np.bincount(unit, weights=weight**2, minlength=j - i))
            dense = np.zeros((j - i, len(self.keys)))
            dense[unit[known], at[known]] = weight[known]
            cosine = np.round(dense @ self.matrix / np.maximum(norm, 1e-9)[:, None], 9)
            for k, best in ((0, cosine.argmax(1)), (2, titles[cosine[:, titles].argmax(1)])):
                out[k][i:j], out[k + 1][i:j] = cosine[np.arange(j - i), best], best
            i = j
        return tuple(out)

    def ordered(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, template: np.ndarray) -> np.ndarray:
        """Which stretches have their template's neighbours: more than ORDER of the pairs that the shorter of the two has."""
        size = np.maximum(hi - lo - 1, 0)
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(owner)) if len(owner) else np.zeros(0, np.int64)
        hit = member(self.pairs, _pair(h[at], h[at + 1], template[owner]))
        most = np.minimum(size, self.length[template] - 1)
        whole = (self.length[template] > BRIEF) | (hi - lo >= self.length[template])
        return whole & ((most == 0) | (np.bincount(owner[hit], minlength=len(lo)) > ORDER * most))

    def denied(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, template: np.ndarray) -> np.ndarray:
        """Before which stretches a negation stands, NEAR words away at most and in the same sentence; or in which, where a statement without one was found."""
        no = np.flatnonzero(member(self.negations, h))
        out = np.zeros(len(lo), bool)
        if not len(no) or not len(lo):
            return out
        ends = np.array([m.start() for m in _SENTENCE.finditer(low.tobytes())], np.int64)
        k = np.searchsorted(no, lo) - 1
        last = no[np.maximum(k, 0)]
        near = (k >= 0) & (lo - last <= NEAR)
        out[near] = np.searchsorted(ends, starts[lo[near]]) == np.searchsorted(ends, stops[last[near]] - 1)
        return out | (self.plain[template] & (np.searchsorted(no, lo) < np.searchsorted(no, hi)))

    def scan(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[str | None, float, int, float]]:
        """Of each text the licence, score, number of statements, and their share of the words."""
        low = LOWER[data]
        starts, stops, first = words(low, offsets, ALNUM_OR_WIDE)
        h = word_hashes(low, starts, stops)
        out: list[tuple[str | None, float, int, float]] = [(None, 0.0, 0, 0.0)] * (len(offsets) - 1)
        cue = np.flatnonzero(member(self.cues, h))
        if not len(cue):
            return out
        doc = np.searchsorted(first, cue, side="right") - 1
        some = np.unique(doc)
        before, after = (x.ravel() for x in np.meshgrid(BEFORE, AFTER))
        found = []

        def judged(lo, hi, head) -> None:
            """Scores stretches and keeps those that may count, over all templates or as titles."""
            _, at = np.unique(np.stack([lo, hi, ~head], 1), axis=0, return_index=True)
            lo, hi, head = lo[at], hi[at], head[at]
            score, best, title, best_title = self.scores(h, lo, hi)
            good = score >= threshold
            good[good] = self.ordered(h, lo[good], hi[good], best[good]) & ~self.denied(low, starts, stops, h, lo[good], hi[good], best[good])
            titled = head & (title >= TITLE_THRESHOLD)
            titled[titled] = self.ordered(h, lo[titled], hi[titled], best_title[titled]) & ~self.denied(low, starts, stops, h, lo[titled], hi[titled], best_title[titled])
            keep = good | titled
            found.append(tuple(x[keep] for x in (lo, hi, titled, np.where(good, score, -1.0), best, title, best_title)))

        for k in range(0, len(cue), CUES_AT_ONCE):
            c, of = cue[k : k + CUES_AT_ONCE], doc[k : k + CUES_AT_ONCE]
            lo = np.maximum(first[of][:, None], c[:, None] - before).ravel()
            judged(lo, np.minimum(first[of + 1][:, None], c[:, None] + after).ravel(), np.zeros(len(lo), bool))
        lo = [np.repeat(first[some], len(HEADS) + 1)]
        hi = [np.minimum(first[some + 1][:, None], np.append(first[some][:, None] + np.array(HEADS), first[some + 1][:, None], axis=1)).ravel()]
        head = [np.tile(np.arange(len(HEADS) + 1) < len(HEADS), len(some))]
        for d in some.tolist():
            raw = low[offsets[d] : offsets[d + 1]].tobytes()
            cuts = first[d] + np.searchsorted(starts[first[d] : first[d + 1]] - offsets[d], [0, *(m.end() for m in _BREAK.finditer(raw)), len(raw)])
            holds = np.unique(np.searchsorted(cuts, cue[doc == d] if len(some) == 1 else cue[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")], side="right")) - 1
            lo.append(cuts[holds]), hi.append(cuts[holds + 1]), head.append(np.zeros(len(holds), bool))
        judged(*map(np.concatenate, (lo, hi, head)))
        lo, hi, head, score, best, title, best_title = map(np.concatenate, zip(*found))
        owner = np.searchsorted(first, lo, side="right") - 1
        good = np.flatnonzero(score >= 0)
        good = good[np.lexsort([self.names[best[good]], lo[good], -score[good], owner[good]])]
        titled = np.flatnonzero(head)
        titled = titled[np.lexsort([self.names[best_title[titled]], -title[titled], owner[titled]])]
        lead = dict(zip(owner[titled][::-1].tolist(), titled[::-1].tolist()))
        bound = np.searchsorted(owner[good], np.arange(len(out) + 1))
        for d in np.unique(owner[good]).tolist():
            mine = good[bound[d] : bound[d + 1]]
            covered, count, end = 0, 0, -1
            for a, b in sorted(zip(lo[mine].tolist(), hi[mine].tolist())):
                if a >= end:
                    count += 1
                covered += max(0, b - max(a, end))
                end = max(end, b)
            k = lead.get(d)
            name, value = (self.names[best[mine[0]]], score[mine[0]]) if k is None else (self.names[best_title[k]], title[k])
            if name in self.yields and (of := mine[self.yields[name][1][best[mine]]]).size and score[of].max() >= TITLE_THRESHOLD:
                name = self.yields[name][0]
            out[d] = (str(name), float(value), count, covered / max(1, int(first[d + 1] - first[d])))
        return out


def document_frequency(docs: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """In how many documents each word of the templates stands, and how many documents there are."""
    hashes = _hashes(VOCABULARY)
    order = np.argsort(hashes)
    keys = hashes[order]

    def run(batches):
        seen, total = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                low = LOWER[data[offsets[i] : offsets[j]]]
                starts, stops, first = words(low, offsets[i : j + 1] - offsets[i], ALNUM_OR_WIDE)
                h = word_hashes(low, starts, stops)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                doc = np.searchsorted(first, hit, side="right") - 1
                seen += np.bincount(np.unique(doc * len(keys) + at[hit]) % len(keys), minlength=len(keys))
                total += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(keys))), pa.array(np.concatenate([[total], seen]))], names=["place", "n"])

    got = {r.place: r.n for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return {VOCABULARY[int(order[k])]: n for k, n in got.items() if k >= 0}, got.get(-1, 0)


def parent(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root included."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.array_append(above, F.lit("")))


def scan(files: DataFrame, path: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, limit: int = 32 << 20) -> DataFrame:
    """One row a file: the kept columns, path, license, score, origin (own, inherited or none) and n_statements."""
    scratch, stored = Scratch(files.sparkSession), input_bytes(files)
    scorer = files.sparkSession.sparkContext.broadcast(Scorer(*document_frequency(files, text_col)))
    kept = [f"__k{i}" for i in range(len(keep))]
    df = files.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [*(df.schema[c] for c in (*kept, "path")), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_statements", T.LongType()), T.StructField("share", T.DoubleType())]
    k = len(kept) + 1

    def run(batches):
        s = scorer.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(k))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                found = list(zip(*s.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], threshold)))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(k)), *(pa.array(x, t) for x, t in zip(found, kinds))], names=[f.name for f in fields])

    own = scratch.keep(df.mapInArrow(frugal(run), T.StructType(fields)).withColumn("dir", parent(F.col("path"))), "own", stored)
    whole = F.col("license").isNotNull() & (F.col("path").rlike(_NAMED) | (F.col("share") >= FILE_SHARE))
    rank = F.struct(F.col("score"), F.col("license"))
    declared = own.where(whole).groupBy("dir").agg(F.max_by("license", rank).alias("given"), F.max("score").alias("given_score"))
    declared = scratch.keep(declared, "declared", stored)
    directories = own.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "above"))
    above, size = declared.withColumnRenamed("dir", "above"), declared.agg(F.sum(F.length("dir") + F.length("given") + 100)).first()[0] or 0
    met = directories.join(F.broadcast(above), "above") if size <= limit else salted_join(directories, above, "above", "dir")  # the root is above all
    nearest = scratch.keep(met.groupBy("dir").agg(F.min_by(F.struct("given", "given_score"), "up").alias("near")).select("dir", "near.*"), "nearest", stored)
    out = own.join(measured_side(nearest, F.length("dir") + F.length("given"), limit), "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(
        *(F.col(a).alias(b) for a, b in zip(kept, keep)), "path", F.coalesce("license", "given").alias("license"), F.round(F.when(F.col("license").isNotNull(), F.col("score")).otherwise(F.coalesce("given_score", F.lit(0.0))), 6).alias("score"), origin.alias("origin"), "n_statements"
    )
