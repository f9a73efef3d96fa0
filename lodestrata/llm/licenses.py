"""Licence of each file, package and repository: nearest template by token edit distance in a metric tree."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.lexing import comment_lines, comments, language_of
from lodestrata.llm.licence_texts import BODIES, MORE_NAMES, NAMES

#: Sentences that license what they stand in; {} is a licence's long name.
NOTICES = [
    "This file is made available to you under the terms of {}",
    "You may use, change and pass on this file only as far as {} allows it; there is no warranty",
    "The owners place this work under {}",
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Distributed under the terms of {}",
    "This source code is licensed under {}",
    "Use of this source code is governed by {}",
    "This program is free software; you can redistribute it and/or modify it under the terms of {}",
    "Licensed under {} (the License); you may not use this file except in compliance with the License",
]
CHOICES = ["At your choice, use this file under {} or {}", "Licensed under either of {} or {}", "Dual licensed under {} or {}"]
#: Notices that are a licence by themselves, and sentences that only point elsewhere.
WHOLE = {
    "This file is proprietary and confidential": "proprietary",
    "Proprietary software; no licence is granted to third parties": "proprietary",
    "Unauthorized copying of this file is strictly prohibited, proprietary and confidential": "proprietary",
}
POINTERS = [
    "See the LICENSE file at the top for the terms",
    "See LICENSE for details",
    "See the LICENSE file for license information",
    "See the terms page of the portal",
    "The terms are in the file LICENSE",
    "TODO: choose a licence before the first release",
]

_TOKEN = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_SAME = {"licence": "license", "licensed": "licensed", "v": "version", "two": "2", "three": "3", "public": "public", "licences": "license"}
#: Words that tell licences apart; after the nearest template is found they must agree exactly.
_TELLING = frozenset("mit expat x apache asl bsd simplified freebsd new modified revised isc gnu gpl lgpl agpl lesser library affero mozilla mpl eclipse epl cc unlicense zlib boost bsl proprietary confidential artistic cddl eupl afl osl ofl sil wtfpl ncsa postgresql psf sspl busl mulan zope zpl upl attribution sharealike".split())


def tokens(text: str) -> tuple[str, ...]:
    """Lower-case words and numbers; 'GPLv3' splits into gpl, version and 3, and '2.0' equals '2'."""
    out = []
    for t in _TOKEN.findall(text.lower()):
        if t[0].isdigit():
            out.append(re.sub(r"(?:\.0)+$", "", t))
        elif len(t) > 3 and t.endswith("v") and t[:-1] in _TELLING:
            out += [t[:-1], "version"]
        else:
            out.append(_SAME.get(t, t))
    return tuple(out)


def telling(words: tuple[str, ...]) -> frozenset:
    return frozenset(w for w in words if w in _TELLING or w[0].isdigit())


class Pattern:
    """A token sequence with the bit masks of Myers' algorithm."""

    def __init__(self, words: tuple[str, ...]):
        self.words, self.size, self.masks = words, len(words), {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def distance(self, other: tuple[str, ...]) -> int:
        """Edit distance in tokens, one machine step per token of `other` for all tokens of the pattern at once."""
        if not self.size:
            return len(other)
        full, top, score = (1 << self.size) - 1, 1 << (self.size - 1), self.size
        up, down = full, 0
        for w in other:
            eq = self.masks.get(w, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (~(xh | up) & full), up & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1 | 1) & full, mh << 1 & full
            up, down = mh | (~(xv | ph) & full), ph & xv
        return score


class MetricTree:
    """Nodes keep children by their distance to them; a search enters only distances the triangle inequality allows."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, pattern: Pattern, value: frozenset) -> None:
        if self.root is None:
            self.root = [pattern, [value], {}]
            return
        node = self.root
        while d := node[0].distance(pattern.words):
            if d not in node[2]:
                node[2][d] = [pattern, [value], {}]
                return
            node = node[2][d]
        node[1].append(value)

    def within(self, words: tuple[str, ...], bound: int) -> list[tuple[int, Pattern, frozenset]]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            pattern, values, children = stack.pop()
            d = pattern.distance(words)
            if d <= bound:
                found += [(d, pattern, v) for v in values]
            stack += [child for at, child in children.items() if d - bound <= at <= d + bound]
        return found


class Templates:
    """Templates indexed by length; each length has its own metric tree."""

    def __init__(self, texts: list[tuple[str, frozenset]]):
        self.trees: dict[int, MetricTree] = {}
        for text, value in texts:
            words = tokens(text)
            self.trees.setdefault(len(words), MetricTree()).add(Pattern(words), value)

    def nearest(self, text: str, share: float) -> frozenset | None:
        """Value of the nearest template within `share` of the text's tokens that has the same telling words; else None."""
        words = tokens(text)
        best = self.best(words, share, telling(words)) if words else None
        return best and best[1]

    def best(self, words: tuple[str, ...], share: float, want: frozenset | None = None) -> tuple[int, frozenset] | None:
        """(distance, value) of the nearest template within `share` of the words; `want` are the telling words it must have."""
        bound = int(len(words) * share)
        best: tuple[int, frozenset] | None = None
        for size in range(max(1, len(words) - bound), len(words) + bound + 1):
            if size not in self.trees:
                continue
            for d, pattern, value in self.trees[size].within(words, bound):
                if (want is None or telling(pattern.words) == want) and (best is None or d < best[0]):
                    best = d, value
        return best


def _one(family: str) -> frozenset:
    return frozenset([family])


@lru_cache(maxsize=1)
def name_templates() -> Templates:
    texts = []
    for family, names in (NAMES | MORE_NAMES).items():
        for name in names:
            texts.append((name, _one(family)))
            if re.match(r"(?i)[al]*gpl", name) or "GNU" in name:
                texts += [(f"{name}{end}", _one(family)) for end in ("-only", "-or-later", " only", " or later")]
            bare = re.sub(r"^(?:the|a) ", "", name)
            texts.append((bare if bare != name else f"the {name}", _one(family)))
    return Templates(texts)


@lru_cache(maxsize=1)
def notice_templates() -> Templates:
    texts = [(t, _one(family)) for t, family in WHOLE.items()] + [(t, frozenset()) for t in POINTERS]
    for family, names in (NAMES | MORE_NAMES).items():
        texts += [(notice.format(name), _one(family)) for notice in NOTICES for name in names]
        texts += [(notice.format(names[0] + " or later"), _one(family)) for notice in NOTICES if "gpl" in family]
    for (a, an), (b, bn) in permutations(NAMES.items(), 2):
        texts += [(choice.format(an[0], bn[0]), frozenset([a, b])) for choice in CHOICES]
    return Templates(texts)


class Bodies:
    """Licence texts by their opening words; a window of a template's length from there is looked up in the metric tree."""

    OPENING, SHARE = 4, 0.15

    def __init__(self) -> None:
        self.templates = Templates([(text, _one(family)) for family, texts in BODIES.items() for text in texts])
        self.sizes: dict[tuple[str, ...], set[int]] = {}
        for texts in BODIES.values():
            for text in texts:
                words = tokens(text)
                # any of the first openings may be the one that is left as it was
                for skip in range(0, 9, self.OPENING):
                    self.sizes.setdefault(words[skip : skip + self.OPENING], set()).add((len(words), skip))

    def find(self, words: tuple[str, ...]) -> set[frozenset]:
        """Licences whose text stands in `words` within 15 % of its tokens; of overlapping ones the nearest."""
        hits: dict[tuple[int, int], tuple[float, frozenset]] = {}
        for i in range(len(words) - self.OPENING + 1):
            for size, skip in self.sizes.get(words[i : i + self.OPENING], ()):
                start = max(0, i - skip)
                # a holder's name may make the text longer or shorter than its template
                for length in {size, *(size + k * max(1, size // 25) for k in (-2, -1, 1, 2))} if size > 40 else {size}:
                    window = words[start : start + length]
                    if (start, len(window)) not in hits and len(window) * (1 + self.SHARE) >= size and (best := self.templates.best(window, self.SHARE)):
                        hits[start, len(window)] = best[0] / len(window), best[1]
        found: list[tuple[int, int, frozenset]] = []
        for (start, size), (share, value) in sorted(hits.items(), key=lambda h: (h[1][0] - 0.001 * h[0][1], h[0])):
            if all(start + size <= a or b <= start for a, b, _ in found):
                found.append((start, start + size, value))
        return {value for _, _, value in found}


@lru_cache(maxsize=1)
def bodies() -> Bodies:
    return Bodies()


_LATER = re.compile(r"(?i)\bor[- ](?:later|newer|greater|any later version)\b|\bwith [\w.+-]*exception[\w.+-]*")
_CHOICE = re.compile(r"(?i)\s+or\s+|\s*/\s*|\s*\|\|?\s*")


@lru_cache(maxsize=200_000)
def expression(text: str) -> frozenset:
    """The alternatives a declared value names, 'A or B' being one set; empty if it names no licence.

    A value within a fifth of a template's tokens counts as that licence; 'A and B' joins into one alternative.
    """
    plain = _LATER.sub("", text.strip().strip("()")).strip()
    if (hit := name_templates().nearest(plain, 0.2)) is not None:
        return hit
    if len(parts := [p for p in _CHOICE.split(plain) if p.strip()]) > 1:
        found = [expression(p) for p in parts]
        return frozenset().union(*found) if all(found) else frozenset()
    if len(parts := re.split(r"(?i)\s+and\s+", plain)) > 1:
        found = [expression(p) for p in parts]
        return frozenset(["+".join(sorted("|".join(sorted(f)) for f in found))]) if all(found) else frozenset()
    return frozenset()


_TAG = re.compile(r"(?i)(?:SPDX-License-Identifier|@licen[sc]e|licen[sc]e)\s*:?\s+(.+)$")
_BANNER = re.compile(r"^[\w.@/-]+ v?\d[\w.-]*\s*\|\s*(.+)$")
_HOLDER = re.compile(r"(?i)^(?:copyright\b(?!\s+(?:notices?|holders?|owners?|and|law|ownership|permission)\b)|\(c\)|©)")
_STOP = re.compile(r"(?<=[.!?])\s+")
#: Words of which every template has one; Spark gives only files that match to Python, so nothing else may narrow them.
SIGNAL = r"(?i)licen[sc]|spdx|permission|permitted|public domain|free software|copyright and related|property of|commercial|creative commons|waived|unencumbered|strictly|\b(?:all rights reserved|vim|ruby|openssl|w3c|psl|mulanpsl|ms|asl|0bsd|blueoak|elastic|(?:python|php)-[0-9]|" + "|".join(sorted(_TELLING)) + r")(?:v?[0-9][0-9.]*)?(?![A-Za-z])"
_SIGNAL = re.compile(SIGNAL)


@lru_cache(maxsize=200_000)
def sentence(text: str) -> frozenset:
    """The licence a sentence of a comment grants; mentions, pointers and copyright lines grant none."""
    return notice_templates().nearest(text, 0.2) or frozenset()


@lru_cache(maxsize=50_000)
def body_licences(text: str) -> frozenset:
    return frozenset(bodies().find(tokens(text)))


def text_licences(lines: list[str]) -> set[frozenset]:
    """Licences granted by tags, sentences and whole licence texts; sentences may run over lines, texts over paragraphs."""
    found, prose, whole = set(), [], []
    for line in [*lines, ""]:
        tag = (_TAG.match(line) or _BANNER.match(line)) if line else None
        named = expression(tag.group(1).rstrip(" .")) if tag else frozenset()
        # a wrapped sentence may begin a line with "License" and so on: no tag unless it names one
        if line and not named and not _HOLDER.match(line):
            prose.append(line)
            continue
        found.add(named)
        if prose:
            joined = " ".join(prose)
            if _SIGNAL.search(joined):
                found |= {sentence(s) for s in _STOP.split(joined) if _SIGNAL.search(s)}
            whole += prose
            prose = []
    joined = " ".join(whole)
    if _SIGNAL.search(joined):
        found |= body_licences(joined)
    return found - {frozenset()}


def file_licences(text: str, language: str | None) -> set[frozenset]:
    """Licences that the comments of a source file grant; comments on consecutive lines read on as one."""
    found: set[frozenset] = set()
    block: list[str] = []
    end = -1
    for at, raw in comments(text, language):
        if block and text[end:at].strip():
            found |= text_licences(block)
            block = []
        elif block and text.count("\n", end, at) > 1:
            block.append("")
        block += comment_lines(raw)
        end = at + len(raw)
    return found | (text_licences(block) if block else set())


def _shown(found) -> list[str]:
    return sorted("|".join(sorted(s)) for s in found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def file_licence_sets(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([_shown(file_licences(c, l)) if c else [] for c, l in zip(content, language)])


@F.pandas_udf(T.StringType())
def declared_licence_set(value: pd.Series, text: pd.Series) -> pd.Series:
    """The set a declaration names, by its value or else by its text; empty string if none."""

    def one(v: str | None, t: str | None) -> str:
        named = expression(v) if v else frozenset()
        if not named and t:
            inside = text_licences([line.strip() for line in t.replace("\r", "").split("\n")]) or {expression(t)}
            named = frozenset().union(*inside) if len(inside) == 1 else frozenset()
        return "|".join(sorted(named))

    return pd.Series([one(v, t) for v, t in zip(value, text)])


def _finding(n_sets: Column) -> Column:
    return F.when(n_sets >= 2, "conflict").when(n_sets == 0, "unknown")


def repo_licences(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """project, licence (its set, null unless exactly one), finding; projects without any declaration are unknown.

    Distinct declarations are classified once each; null projects are left out.
    """
    named = declarations.where("project is not null").select("project", "value", "license_text").distinct()
    sets = named.select("project", F.nullif(declared_licence_set("value", "license_text"), F.lit("")).alias("one"))
    everyone = sets.unionByName(files.where("project is not null").select("project").distinct().withColumn("one", F.lit(None).cast("string")))
    counted = everyone.groupBy("project").agg(F.count_distinct("one").alias("n"), F.min("one").alias("one"))
    return counted.select("project", F.when(F.col("n") == 1, F.col("one")).alias("licence"), _finding(F.col("n")).alias("finding"))


def package_licences(records: DataFrame) -> DataFrame:
    """node, licence, finding over all licence entries of all records of a node; null nodes are left out."""
    entries = records.where("node is not null").select("node", F.explode_outer("licenses").alias("entry")).distinct()
    sets = entries.select("node", F.nullif(declared_licence_set("entry", F.lit(None).cast("string")), F.lit("")).alias("one"))
    counted = sets.groupBy("node").agg(F.count_distinct("one").alias("n"), F.min("one").alias("one"))
    return counted.select("node", F.when(F.col("n") == 1, F.col("one")).alias("licence"), _finding(F.col("n")).alias("finding"))


def files_with_licences(files: DataFrame) -> DataFrame:
    """file_id, project, sets: the licences the comments of each file grant; null content is left out, repeats count once."""
    text = F.when(F.col("content").rlike(SIGNAL), F.col("content"))
    found = files.where("content is not null and file_id is not null").select("file_id", "project", file_licence_sets(text, language_of()).alias("sets"))
    return found.groupBy("file_id").agg(F.min("project").alias("project"), F.array_sort(F.flatten(F.collect_set("sets"))).alias("sets")).withColumn("sets", F.array_distinct("sets"))


def file_findings(files: DataFrame, repos: DataFrame) -> DataFrame:
    """file_id, licence, finding: conflict among its notices or with a known repository licence, unknown without any.

    A file whose repository conflicts or is unknown is judged by its own notices alone.
    """
    own = files_with_licences(files).join(repos.select("project", F.col("licence").alias("repo_licence"), F.col("finding").alias("repo_finding")), "project", "left")
    split = lambda c: F.split(c, r"\|")
    first = F.get("sets", 0)
    clash = F.col("repo_licence").isNotNull() & ~F.arrays_overlap(split(first), split(F.col("repo_licence")))
    unclear = F.col("repo_licence").isNull()
    n = F.size("sets")
    finding = F.when(n >= 2, "conflict").when((n == 1) & clash, "conflict").when((n == 0) & unclear, "unknown")
    licence = F.when(n == 1, first).when(n == 0, F.col("repo_licence"))
    return own.select("file_id", "project", licence.alias("licence"), finding.alias("finding"))


def licence_findings(files: DataFrame, declarations: DataFrame, packages: DataFrame) -> DataFrame:
    """(scope, item, finding) of every repository, package node and file that conflicts or is unknown."""
    repos = repo_licences(declarations, files)
    parts = [
        repos.select(F.lit("repo").alias("scope"), F.col("project").alias("item"), "finding"),
        package_licences(packages).select(F.lit("package").alias("scope"), F.col("node").alias("item"), "finding"),
        file_findings(files, repos).select(F.lit("file").alias("scope"), F.col("file_id").cast("string").alias("item"), "finding"),
    ]
    return reduce(DataFrame.unionByName, parts).where("finding is not null")
