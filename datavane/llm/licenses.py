"""Licence scans: TF-IDF cosine of lines and blocks to notice templates, then inheritance along directories."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CC = "Attribution", "Attribution-NonCommercial", "Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-ShareAlike", "Attribution-NoDerivatives", "Attribution-ShareAlike"
_SHORT = {"Attribution": "BY", "NonCommercial": "NC", "NoDerivatives": "ND", "ShareAlike": "SA"}


def _notices():
    """(licence id, notice): titles and bodies first, then the usual short notices with every name of the licence."""
    gnu = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",))}
    dates = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
    names: dict[str, list[str]] = {}
    out = []
    for kind, (name, versions) in gnu.items():
        for v in versions:
            short = v.removesuffix(".0")
            if f"{kind}-{v}" in dates:
                out.append((f"{kind}-{v}-only", f"{name} Version {short}, {dates[f'{kind}-{v}']}"))
            names[f"{kind}-{v}-only"] = [f"{name}, version {short}", f"{name} v{v}", f"{kind} v{short}", f"{kind}v{short}", f"{kind} {v}"]
            names[f"{kind}-{v}-or-later"] = [f"{name}, version {short} or later", f"{name}, version {short} or any later version", f"{kind} v{short} or later", f"{kind}v{short} or later", f"{kind} {v} or later"]
            what = "library" if kind == "LGPL" else "program"
            for start in (f"This {what} is free software: you can", f"This {what} is free software; you can"):
                out.append((f"{kind}-{v}-or-later", f"{start} redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {short} of the License, or (at your option) any later version."))
            out.append((f"{kind}-{v}-only", f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} version {short} as published by the Free Software Foundation."))
    for kind in _CC:
        code = "-".join(["CC", *(_SHORT[x] for x in kind.split("-"))])
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            scope = {"4.0": "International", "3.0": "Unported"}.get(v, "Generic")
            names[f"{code}-{v}"] = [f"Creative Commons {kind} {v} {scope} License", f"Creative Commons {kind} {v}", f"CC {code[3:]} {v}"]
            out.append((f"{code}-{v}", f"Creative Commons {kind} {v} {scope} Public License"))
    out += [
        ("Apache-2.0", "Apache License Version 2.0, January 2004"),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
        ("X11", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. Except as contained in this notice, the name"),
        ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. THE SOFTWARE IS PROVIDED \"AS IS\""),
        *((name, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Redistributions in binary form must reproduce the above copyright notice." + more) for name, more in (("BSD-2-Clause", ""), ("BSD-3-Clause", " Neither the name of the copyright holder"), ("BSD-4-Clause", " All advertising materials"))),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0."),
        ("CC0-1.0", "CC0 1.0 Universal"),
    ]
    names |= {"MIT": ["MIT License"], "MIT-0": ["MIT No Attribution License"], "Apache-1.1": ["Apache License, Version 1.1"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"], "BSD-4-Clause": ["BSD 4-Clause License"], "0BSD": ["Zero-Clause BSD License"]}
    names |= {"ISC": ["ISC License"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"], **{f"MPL-{v}": [f"Mozilla Public License {v}", f"Mozilla Public License, version {v}", f"MPL {v}"] for v in ("1.0", "1.1", "2.0")}, **{f"EPL-{v}": [f"Eclipse Public License {v}", f"Eclipse Public License v{v}", f"EPL {v}"] for v in ("1.0", "2.0")}}
    for label, all_names in names.items():
        out.append((label, f"SPDX-License-Identifier: {label}"))
        for name in all_names:
            for cue in ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Licensed under the terms of the {}.", "License: {}"):
                out.append((label, cue.format(name)))
    return tuple(out)


TEMPLATES = _notices()
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_PLUS = re.compile(r"\+(?<=[0-9]\+)(?![0-9])")


def plain(text: str) -> str:
    """text in small letters, with one spelling of license and of the `+` after a version."""
    return _PLUS.sub(" or later", text.lower().replace("licence", "license"))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(plain(text))


_N = r"(?P<%s>[1-4](?:\.[0-9])?)(?= |$)"
_LATER = r"or (?:at your option )?(?:any )?(?:later|newer)(?: version)?(?= |$)|(?:and|or) (?:above|higher)(?= |$)"
_FREE = r"permission is hereby granted free of charge to any person obtaining a copy"
_ISC = r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"
_FORMS = r"redistribution and use in source and binary forms with or without modification are permitted"
#: What names a licence, with all its words that tell variants apart, in a text of tokens with a blank between them.
_NAMED = re.compile(
    r"(?<![^ ])(?:"
    rf"(?P<gnu>(?:(?:version |v ?){_N % 'g0'} (?P<l0>(?:{_LATER}) )?of the )?(?:gnu )?(?:(?P<kind>affero|lesser|library) )?(?:general public license|(?P<abbr>[al]?gpl))(?: license)?(?: [al]?gpl)?(?: as published by the free software foundation)?"
    rf"(?:(?: either)?(?: version | v ?| |(?<=gpl)v?){_N % 'g1'}(?: of the (?:gnu )?(?:[a-z]+ )?(?:general public )?license)?)?(?P<l1> (?:{_LATER}))?(?: only(?= |$))?)"
    rf"|(?P<cc>(?:creative commons|cc)(?: license)? (?:attribution|by)(?P<flags>(?: (?:non ?commercial|nc|share ?alike|sa|no ?deriv(?:ative)?s?(?: works)?|nd))*)(?: (?:international|unported|generic|public|license))*(?: version| v)? v?{_N % 'c1'}(?P<port> (?:united states|us|germany|de|austria|australia|au|netherlands|nl|france|fr|united kingdom|uk|england|japan|jp|igo)(?= |$))?)"
    rf"|(?P<zero>(?:cc0|cc zero|creative commons (?:zero|0|cc0))(?: public domain dedication)?(?: universal)?(?: (?:version |v ?)?{_N % 'z1'})?)"
    rf"|(?P<apache>apache(?: software)?(?: license)?(?: version| v)? v?{_N % 'a1'})"
    rf"|(?P<mpl>(?:mozilla public license|mpl)(?: mpl)?(?: version| v)? ?v?{_N % 'm1'})"
    rf"|(?P<epl>(?:eclipse public license|epl)(?: version| v)? ?v?{_N % 'e1'})"
    r"|(?P<mit>(?:mit|expat) license(?:d)?|license(?:d under)?(?: identifier)?(?: the)? mit)(?P<none> no attribution| 0)?(?= |$)"
    r"|(?P<zeromit>mit (?:no attribution|0))(?= |$)"
    r"|(?P<bsd>(?:(?P<b0>0|2|3|4|zero|two|three|four) clause |(?P<b1>new|modified|revised|simplified|freebsd|original) )*bsd(?: (?P<b2>0|2|3|4|zero|two|three|four) clause)?)(?= |$)|(?P<zbsd>0bsd)(?= |$)"
    r"|(?P<isc>isc license|license(?:d under)?(?: identifier)?(?: the)? isc)(?= |$)"
    rf"|(?P<unl>unlicense)(?= |$)|(?P<unb>free and unencumbered software released into the public domain)"
    rf"|(?P<free>{_FREE})|(?P<iscbody>{_ISC})(?P<prov> provided)?|(?P<forms>{_FORMS})"
    r")(?P<with> with (?:the )?(?:[a-z0-9.]+ ){0,3}exception)?"
)
#: Every name above holds one of these; other texts need no further look.
_HINT = re.compile(r"licen|gpl|bsd|apache|commons|cc0|hereby|redistribution|unencumbered|cc(?<![a-z0-9]cc)(?![a-z0-9])|[me]pl(?<![a-z0-9][a-z]pl)(?:v?[0-9]|[^a-z]|$)|mit(?<![a-z0-9]mit)[^a-z0-9]+(?:no[^a-z0-9]+attribution|0)(?![a-z0-9])")
_CLAUSES = {"0": "0BSD", "zero": "0BSD", "2": "BSD-2-Clause", "two": "BSD-2-Clause", "simplified": "BSD-2-Clause", "freebsd": "BSD-2-Clause", "3": "BSD-3-Clause", "three": "BSD-3-Clause", "new": "BSD-3-Clause", "modified": "BSD-3-Clause", "revised": "BSD-3-Clause", "4": "BSD-4-Clause", "four": "BSD-4-Clause", "original": "BSD-4-Clause"}
_OR_OTHER = re.compile(r" (?:and|or) (?:version |v ?)?[1-4]")
_BODIES = ("free", "iscbody", "forms")  # matches that are the first words of a licence's own text


def _label(m: re.Match, end: int) -> str | None:
    """The licence that a match of _NAMED stands for; None where a word that tells variants apart is missing.

    end: where a licence's own text that begins with the match ends at the latest, however long it is."""
    g = m.groupdict()
    full = lambda v: v if "." in v else v + ".0"
    held = lambda words: m.string.find(words, m.end(), end) >= 0
    if g["with"]:
        return None
    if g["gnu"]:
        v = {full(x) for x in (g["g0"], g["g1"]) if x}
        if len(v) != 1 or _OR_OTHER.match(m.string, m.end()):
            return None
        kind = {"affero": "AGPL", "lesser": "LGPL", "library": "LGPL"}.get(g["kind"]) or (g["abbr"] or "gpl").upper()
        return f"{kind}-{v.pop()}-{'or-later' if g['l0'] or g['l1'] else 'only'}"
    if g["cc"]:
        flags = g["flags"].replace("non commercial", "nc").replace("noncommercial", "nc").replace("share alike", "sa").replace("sharealike", "sa")
        flags = {"nd" if f.startswith(("no", "nd", "deriv", "works")) else f for f in flags.split()}
        if g["port"] or {"sa", "nd"} <= flags:
            return None
        return "-".join(["CC-BY", *(f.upper() for f in sorted(flags)), full(g["c1"])])
    if g["zero"]:
        return "CC0-1.0" if full(g["z1"] or "1") == "1.0" else None
    for key, v, name in (("apache", "a1", "Apache"), ("mpl", "m1", "MPL"), ("epl", "e1", "EPL")):
        if g[key]:
            return f"{name}-{full(g[v])}"
    if g["mit"] or g["zeromit"]:
        return "MIT-0" if g["none"] or g["zeromit"] else "MIT"
    if g["bsd"] or g["zbsd"]:
        found = {"0BSD"} if g["zbsd"] else {_CLAUSES[g[k]] for k in ("b0", "b1", "b2") if g[k]}
        return found.pop() if len(found) == 1 else None
    if g["unl"] or g["unb"]:
        return "Unlicense"
    if g["isc"]:
        return "ISC"
    if g["free"]:
        if held("except as contained in this notice"):
            return "X11"
        return "MIT-0" if held("software is provided as is") and not held("notice shall be included") else "MIT"
    if g["iscbody"]:
        return "ISC" if g["prov"] else "0BSD"
    for mark, name in (("all advertising materials", "BSD-4-Clause"), ("neither the name", "BSD-3-Clause"), ("redistributions in binary form must reproduce", "BSD-2-Clause")):
        if held(mark):
            return name
    return None


def named(words: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first word, word after the last) of all that words name with every word that tells variants apart.

    A licence's own text reaches to the first words of the next one, or to the end."""
    text = " ".join(words)
    ends = [len(w) + 1 for w in words]
    starts = [0, *itertools.accumulate(ends)]
    out, end = [], len(text)
    for m in reversed(list(_NAMED.finditer(text))):
        label = _label(m, end)
        if any(m[b] for b in _BODIES):
            end = m.start()
        if label:
            out.append((label, bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_left(starts, m.end())))
    return out[::-1]


#: Words of fewer than one in so many files weigh alike, so the table of frequencies has at most RARE x words a file rows.
RARE = 100


def frequencies(files: DataFrame, always: set[str]) -> tuple[int, dict[str, int]]:
    """(files, {word: files that hold it}) of all words in at least one of RARE files, and of the words in always."""
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "licence", "license"), F.lit(f"({_TOKEN.pattern})"), 1))
    counts = files.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))  # '' stands for all files
    counts = common.saved(counts, "license_words")
    total = counts.where("word = ''").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    kept = counts.where(F.col("word").isin(sorted(always)) | (F.col("n") * RARE >= total)).where("word <> ''").collect()
    return total, {r.word: r.n for r in kept}


class Templates:
    """Sparse TF-IDF vectors of the templates: idf = 1 + ln((1 + N) / (1 + df)), where df counts as N / RARE at least.

    N and df are those of the files when counts (see frequencies()) are given, else those of the templates."""

    def __init__(self, templates, floor: float, counts: tuple[int, dict[str, int]] | None = None):
        self.names = [t[0] for t in templates]
        bags = [Counter(tokens(t[1])) for t in templates]
        n, df = counts or (len(bags), Counter(w for bag in bags for w in bag))
        least = n / RARE if counts else 0
        self.other = 1 + math.log((1 + n) / (1 + least))
        self.idf = {w: 1 + math.log((1 + n) / (1 + max(c, least))) for w, c in df.items()}
        self.floor = floor
        self.of: dict[str, list] = {}
        for j, bag in enumerate(bags):
            weight = {w: c * self.idf.get(w, self.other) for w, c in bag.items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            self.of.setdefault(self.names[j], []).append((j, sum(bag.values()), {w: x / norm for w, x in weight.items()}))
        self.sizes = {label: sorted({size for _, size, _ in own}) for label, own in self.of.items()}
        self.any = _HINT

    def cosine(self, words: list[str], label: str) -> tuple[float, int]:
        """The best cosine of words to a template of one licence, and that template (the earlier one of equal ones)."""
        weight = {w: c * self.idf.get(w, self.other) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        cos, j = max(((round(sum(x * v[w] for w, x in weight.items() if w in v) / norm, 9), -j) for j, _, v in self.of.get(label, ())), default=(0.0, 1))
        return cos, -j

    def best(self, words: list[str]) -> tuple[float, int]:
        """The best cosine of words to a template of a licence that they name."""
        cos, j = max(((c, -j) for c, j in (self.cosine(words, x) for x in {x for x, _, _ in named(words)})), default=(0.0, 1))
        return cos, -j


def _laid_out(text: str) -> tuple[list[str], list[int], dict[str, list[int]]]:
    """Tokens of a text, the line of each, and where the lines, sentences and blocks of lines begin (as token numbers)."""
    words, lines, first = [], [], {"line": [0], "sentence": [0], "block": [0]}
    line, end = 0, 0
    for m in _TOKEN.finditer(text):
        gap = text[end : m.start()]
        breaks = gap.count("\n")
        if words:
            if breaks:
                first["line"].append(len(words))
            blank = _BLANK.search(gap) is not None
            if blank:
                first["block"].append(len(words))
            if blank or _STOP.search(gap):
                first["sentence"].append(len(words))
        line += breaks
        words.append(m.group())
        lines.append(line)
        end = m.end()
    return words, lines, first


_BLANK, _STOP = re.compile(r"\n\s*\n"), re.compile(r"[.!?]\W*\s")


def scan(files: DataFrame, templates=TEMPLATES, floor: float = 0.6) -> DataFrame:
    """doc_id, path, own_license, own_score, own_line of every whole text of files (doc_id, path, text).

    A licence counts where the text names it with all words that tell variants apart (version, `or later`, clauses, NC,
    ND, SA), also across line breaks; what names none, or one without templates, gets no label. Around each such place
    these units are scored: its lines, its sentences, its runs of lines between blank lines, and all windows as long as a
    template of that licence. The unit with the highest cosine to a template of the licence that it names wins when it
    reaches floor (ties: earlier template, then earlier line). Document frequencies are counted over all files.
    own_line is the line of the unit's first word.
    Null or empty texts, and texts without a match, have null results. Repeated rows are scanned one by one."""
    model = Templates(templates, floor, frequencies(files, {w for t in templates for w in tokens(t[1])}))

    def look(text):
        text = plain(text) if text else ""
        if not model.any.search(text):
            return None, None, None
        words, lines, first = _laid_out(text)
        hit, seen = (0.0, 0, 0), set()
        for label, a, b in named(words):
            own = model.of.get(label)
            if not own or (hit[0] == 1.0 and -hit[1] <= own[0][0]):
                continue  # a later place of the same score loses the tie
            spans = {(at[bisect.bisect_right(at, a) - 1], (at[x] if (x := bisect.bisect_left(at, b)) < len(at) else len(words))) for at in first.values()}
            for size in model.sizes[label]:
                if size <= b - a:
                    spans.add((a, b))
                else:
                    spans.update((lo, min(lo + size, len(words))) for lo in range(max(0, b - size), a + 1))
            for lo, hi in spans:
                if (label, lo, hi) not in seen:
                    if hi - lo > b - a + 200:
                        seen.add((label, lo, hi))  # long units hold many places
                    cos, j = model.cosine(words[lo:hi], label)
                    if j >= 0 and (cos, -j, -lines[lo]) > hit:
                        hit = (cos, -j, -lines[lo])
        return (model.names[-hit[1]], round(hit[0], 6), -hit[2]) if hit[0] >= floor else (None, None, None)

    def run(frames):
        for f in frames:
            got = [look(t) for t in f["text"]]
            f["own_license"], f["own_score"], f["own_line"] = [g[0] for g in got], pd.array([g[1] for g in got], "Float64"), pd.array([g[2] for g in got], "Int64")
            yield f.drop(columns="text")

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "path", "text").mapInPandas(run, f"doc_id {kind}, path string, own_license string, own_score double, own_line long")


def inherit(scanned: DataFrame, file_names: str = "LICENSE") -> DataFrame:
    """Give each file its licence: its own, else that of the nearest ancestor directory which holds a licence file.

    scanned: the result of scan(). A licence file is one whose name is in file_names (a regular expression of whole names);
    of several in a directory that name a licence the best score, then the smaller name counts, then the smaller licence id. Distinct directories, not files, are
    joined with their ancestors, so a directory with a third of all files is one row there; the last join on the
    directory can be split by skew handling. A null path inherits nothing.
    Adds license, basis (own, inherited, none) and license_dir."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = common.saved(scanned, "licenses").withColumn("dir", folder)  # read several times below, scanned once
    name = F.regexp_extract("path", "[^/]*$", 0)
    held = rows.where(F.col("own_license").isNotNull() & name.rlike(f"^(?:{file_names})$"))
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), name.alias("n"), F.col("own_license").alias("l"))).alias("m")).select(F.col("dir").alias("anc"), F.col("m.l").alias("inherited"))
    dirs = rows.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(F.split(F.col("dir"), "/"), F.lit(1), i), "/"))).alias("depth", "anc"))
    near = up.join(held, "anc").groupBy("dir").agg(F.max(F.struct("depth", "anc", "inherited")).alias("m")).select("dir", F.col("m.anc").alias("anc"), F.col("m.inherited").alias("inherited"))
    near = common.saved(near, "inherited")  # so that both sides of the join are shuffled for it, which lets a hot directory be split
    nowhere = rows.where("dir is null").select("*", F.lit(None).cast("string").alias("anc"), F.lit(None).cast("string").alias("inherited"))
    out = rows.where("dir is not null").join(near, "dir", "left").select(*rows.columns, "anc", "inherited").unionByName(nowhere)
    own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score", "own_line",
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(own, F.col("dir")).otherwise(F.col("anc")).alias("license_dir"),
    )
