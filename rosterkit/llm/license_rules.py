"""Ordered signature rules for license texts, notices and names.

A pattern is a regular expression over the words of a text, lower-cased and one blank apart: a blank separates words,
``\\S+`` is any word, groups never capture.  Whole words match only.  The rules are written as tables of names and notices
and of the sentences that tell license texts apart; notices are made from the names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Priorities, first to last: a license's own words or tag; a notice that names it with its version; its name; a hint.
TEXT, NOTICE, NAME, HINT = range(4)

# The base phrases and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# End of fixed values.

_V = "(?:version |v |v|ver )?"
_LICENSE = "(?:license|licence)"
_GIVEN = "(?:licensed|licenced|released|distributed|available|provided|published|covered|redistributed|dual licensed|made available|is)"
_UNDER = f"{_GIVEN} (?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"

# Label, then patterns of the name; the label's words are the tag as well.
_NAMES: list[tuple[str, list[str]]] = [
    ("apache-1.0", [f"apache (?:software )?{_LICENSE} {_V}1 0", "asl 1 0"]),
    ("apache-1.1", [f"apache (?:software )?{_LICENSE} {_V}1 1", "asl 1 1"]),
    ("apache-2.0", [f"apache (?:software )?{_LICENSE} {_V}2(?: 0)?", "apache 2 0", "asl 2 0", "al2"]),
    ("mit", [f"mit (?:style |x11 |open source )?{_LICENSE}", "mit x11", f"expat {_LICENSE}"]),
    ("mit-0", [f"mit no attribution(?: {_LICENSE})?", "mit 0"]),
    ("x11", [f"x11 {_LICENSE}", f"x consortium {_LICENSE}"]),
    ("isc", [f"isc {_LICENSE}", f"internet systems consortium {_LICENSE}"]),
    ("0bsd", [f"bsd zero clause(?: {_LICENSE})?", f"zero clause bsd(?: {_LICENSE})?"]),
    ("bsd-2-clause", [f"(?:simplified|freebsd|2 clause|two clause) bsd(?: {_LICENSE})?", f"bsd (?:2|two) clause(?: {_LICENSE})?", f"freebsd {_LICENSE}"]),
    ("bsd-3-clause", [f"(?:new|revised|modified|3 clause|three clause) bsd(?: {_LICENSE})?", f"bsd (?:3|three) clause(?: {_LICENSE})?"]),
    ("bsd-4-clause", [f"(?:original|old|4 clause|four clause) bsd(?: {_LICENSE})?", f"bsd (?:4|four) clause(?: {_LICENSE})?"]),
    ("bsd", [f"bsd (?:style )?{_LICENSE}", f"berkeley software distribution {_LICENSE}"]),
    ("gpl-1.0", [f"(?:gnu )?general public {_LICENSE} {_V}1(?: 0)?", f"(?:gnu )?gpl {_V}1(?: 0)?", "gplv1"]),
    ("gpl-2.0", [f"(?:gnu )?general public {_LICENSE} {_V}2(?: 0)?", f"(?:gnu )?gpl {_V}2(?: 0)?", "gplv2"]),
    ("gpl-3.0", [f"(?:gnu )?general public {_LICENSE} {_V}3(?: 0)?", f"(?:gnu )?gpl {_V}3(?: 0)?", "gplv3"]),
    ("gpl-2.0-or-later", [f"(?:gnu )?general public {_LICENSE} {_V}2(?: 0)? or (?:any )?(?:later|newer)(?: version)?",
                          f"(?:gnu )?gpl {_V}2(?: 0)? or (?:any )?(?:later|newer)(?: version)?", "gplv2 or (?:any )?later"]),
    ("gpl-3.0-or-later", [f"(?:gnu )?general public {_LICENSE} {_V}3(?: 0)? or (?:any )?(?:later|newer)(?: version)?",
                          f"(?:gnu )?gpl {_V}3(?: 0)? or (?:any )?(?:later|newer)(?: version)?", "gplv3 or (?:any )?later"]),
    ("lgpl-2.0", [f"(?:gnu )?library general public {_LICENSE} {_V}2(?: 0)?", f"(?:gnu )?lgpl {_V}2 0", f"(?:gnu )?library general public {_LICENSE}"]),
    ("lgpl-2.1", [f"(?:gnu )?lesser general public {_LICENSE} {_V}2 1", f"(?:gnu )?lgpl {_V}2 1", "lgplv2 1"]),
    ("lgpl-3.0", [f"(?:gnu )?lesser general public {_LICENSE} {_V}3(?: 0)?", f"(?:gnu )?lgpl {_V}3(?: 0)?", "lgplv3"]),
    ("lgpl-2.1-or-later", [f"(?:gnu )?lesser general public {_LICENSE} {_V}2 1 or (?:any )?(?:later|newer)(?: version)?",
                           f"(?:gnu )?lgpl {_V}2 1 or (?:any )?(?:later|newer)(?: version)?"]),
    ("agpl-3.0", [f"(?:gnu )?affero general public {_LICENSE} {_V}3(?: 0)?", f"(?:gnu )?agpl {_V}3(?: 0)?", "agplv3"]),
    ("agpl-3.0-or-later", [f"(?:gnu )?affero general public {_LICENSE} {_V}3(?: 0)? or (?:any )?(?:later|newer)(?: version)?"]),
    ("gfdl-1.3", [f"(?:gnu )?free documentation {_LICENSE} {_V}1 3", f"gfdl {_V}1 3"]),
    ("gfdl", [f"(?:gnu )?free documentation {_LICENSE}"]),
    ("lgpl", [f"(?:gnu )?lesser general public {_LICENSE}", f"gnu lgpl(?: {_LICENSE})?"]),
    ("agpl", [f"(?:gnu )?affero general public {_LICENSE}", f"gnu agpl(?: {_LICENSE})?"]),
    ("gnu-gpl", [f"gnu general public {_LICENSE}", "gnu gpl", f"gpl {_LICENSE}"]),
    ("mpl-1.0", [f"mozilla public {_LICENSE} {_V}1 0", f"mpl {_V}1 0"]),
    ("mpl-1.1", [f"mozilla public {_LICENSE} {_V}1 1", f"mpl {_V}1 1"]),
    ("mpl-2.0", [f"mozilla public {_LICENSE} {_V}2 0", f"mpl {_V}2 0", "mplv2(?: 0)?"]),
    ("epl-1.0", [f"eclipse public {_LICENSE} {_V}1 0", f"epl {_V}1 0"]),
    ("epl-2.0", [f"eclipse public {_LICENSE} {_V}2 0", f"epl {_V}2 0"]),
    ("edl-1.0", [f"eclipse distribution {_LICENSE} {_V}1 0"]),
    ("cddl-1.0", [f"common development and distribution {_LICENSE} {_V}1 0", f"cddl {_V}1 0"]),
    ("cddl-1.1", [f"common development and distribution {_LICENSE} {_V}1 1", f"cddl {_V}1 1"]),
    ("cpl-1.0", [f"common public {_LICENSE} {_V}1 0"]),
    ("eupl-1.1", [f"european union public {_LICENSE} {_V}1 1", f"eupl {_V}1 1"]),
    ("eupl-1.2", [f"european union public {_LICENSE} {_V}1 2", f"eupl {_V}1 2"]),
    ("artistic-1.0", [f"artistic {_LICENSE} {_V}1 0"]),
    ("artistic-2.0", [f"artistic {_LICENSE} {_V}2 0"]),
    ("afl-3.0", [f"academic free {_LICENSE} {_V}3 0", f"afl {_V}3 0"]),
    ("osl-3.0", [f"open software {_LICENSE} {_V}3 0", f"osl {_V}3 0"]),
    ("ofl-1.1", [f"(?:sil )?open font {_LICENSE} {_V}1 1", f"sil open font {_LICENSE}", f"ofl {_V}1 1"]),
    ("odbl-1.0", [f"open (?:data commons open )?database {_LICENSE}(?: {_V}1 0)?", f"odbl {_V}1 0"]),
    ("odc-by-1.0", [f"open data commons attribution {_LICENSE}(?: {_V}1 0)?"]),
    ("pddl-1.0", [f"public domain dedication and {_LICENSE}(?: {_V}1 0)?"]),
    ("cdla-permissive-2.0", [f"community data {_LICENSE} agreement permissive(?: {_V}2 0)?"]),
    ("psf-2.0", [f"python software foundation {_LICENSE}(?: {_V}2(?: 0)?)?", f"psf {_LICENSE}"]),
    ("php-3.01", [f"php {_LICENSE} {_V}3 (?:01|0 1)", f"php {_LICENSE}"]),
    ("ruby", [f"ruby {_LICENSE}"]),
    ("zlib", [f"zlib (?:libpng )?{_LICENSE}"]),
    ("libpng", [f"libpng {_LICENSE}"]),
    ("bsl-1.0", [f"boost software {_LICENSE}(?: {_V}1 0)?"]),
    ("busl-1.1", [f"business source {_LICENSE}(?: {_V}1 1)?", f"busl {_V}1 1"]),
    ("sspl-1.0", [f"server side public {_LICENSE}(?: {_V}1)?", f"sspl {_V}1"]),
    ("elastic-2.0", [f"elastic {_LICENSE}(?: {_V}2 0)?"]),
    ("openssl", [f"openssl {_LICENSE}"]),
    ("unlicense", ["(?:the )?unlicense", f"un {_LICENSE} org"]),
    ("wtfpl", ["wtfpl", f"do what the (?:fuck|f) you want to public {_LICENSE}"]),
    ("vim", [f"vim {_LICENSE}"]),
    ("w3c", [f"w3c software (?:notice and )?{_LICENSE}"]),
    ("upl-1.0", [f"universal permissive {_LICENSE}(?: {_V}1 0)?"]),
    ("ms-pl", [f"microsoft public {_LICENSE}"]),
    ("ms-rl", [f"microsoft reciprocal {_LICENSE}"]),
    ("ncsa", [f"university of illinois (?:ncsa )?open source {_LICENSE}", f"ncsa open source {_LICENSE}"]),
    ("postgresql", [f"postgresql {_LICENSE}"]),
    ("blueoak-1.0.0", [f"blue oak model {_LICENSE}(?: {_V}1 0 0)?"]),
    ("hippocratic-2.1", [f"hippocratic {_LICENSE}(?: {_V}2 1)?"]),
    ("openrail", [f"openrail {_LICENSE}", f"open rail {_LICENSE}", f"(?:creativeml )?open rail m(?: {_LICENSE})?", f"bigscience (?:open )?rail {_LICENSE}"]),
    ("cc0-1.0", ["cc0(?: 1 0)?(?: universal)?", "creative commons zero(?: v1 0)?(?: universal)?", "cc zero"]),
    ("cc-pdm-1.0", ["creative commons public domain mark(?: 1 0)?"]),
    ("open-government-3.0", [f"open government {_LICENSE}(?: {_V}3 0)?"]),
]

# Creative Commons: the elements in words, and the versions.
_COMMONS = {
    "by": "attribution", "by-sa": "attribution (?:sharealike|share alike)", "by-nd": "attribution (?:noderivs|noderivatives|no derivs|no derivatives|no derivative works)",
    "by-nc": "attribution (?:noncommercial|non commercial)", "by-nc-sa": "attribution (?:noncommercial|non commercial) (?:sharealike|share alike)",
    "by-nc-nd": "attribution (?:noncommercial|non commercial) (?:noderivs|noderivatives|no derivs|no derivatives|no derivative works)",
}
_COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# Label and a sentence of the license's own words, or of the notice its files carry.
_SENTENCES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
              "permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "neither the names? of (?:the )?(?:\\S+ ){1,12}nor the names of (?:its|the|any|other) (?:\\S+ )?contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-1.0", "as published by the free software foundation either version 1 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-or-later", "as published by the free software foundation either version 2 (?:of the license )?or at your option any later version"),
    ("lgpl-2.1-or-later", "as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version"),
    ("gpl-3.0-or-later", "as published by the free software foundation either version 3 (?:of the license )?or at your option any later version"),
    ("gpl-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|file|software|library)"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:program|file|software|library)"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this (?:program|file|software)"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v)?2 0"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl", "you just do what the (?:fuck|f) you want to"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "this product includes php software freely available from"),
    ("psf-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:\\S+ ){0,4}to deal with the software without restriction"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with"),
    ("cc0-1.0", "to the extent possible under law (?:\\S+ ){1,10}has waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("odbl-1.0", "this \\S+ database is made available under the open database license"),
    ("cdla-permissive-2.0", "a data recipient may use modify and share the data made available by data provider"),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
]

# Label and a phrase that speaks of rights without naming a license.
_HINTS: list[tuple[str, str]] = [
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("public-domain", "public domain (?:work|dedication|mark)"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution|duplication)(?: \\S+){0,8} (?:is )?(?:strictly )?(?:prohibited|forbidden)"),
    ("proprietary", "unauthorised (?:copying|reproduction|use|distribution|duplication)(?: \\S+){0,8} (?:is )?(?:strictly )?(?:prohibited|forbidden)"),
    ("proprietary", "may not be (?:reproduced|copied|distributed|republished|transmitted)(?: \\S+){0,10} without (?:the )?(?:\\S+ )?(?:prior |express )?(?:written )?(?:permission|consent)"),
    ("proprietary", "no part of this (?:publication|book|work|document|site) may be"),
    ("proprietary", f"end user {_LICENSE} agreement"),
    ("proprietary", f"commercial {_LICENSE}"),
    ("proprietary", "trade secrets? of"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", "(?:c )?copyright (?:by|of|holders?|owners?|notice)"),
    ("creative-commons", f"creative commons(?: {_LICENSE})?"),
    ("creative-commons", "creativecommons org licenses"),
    ("open-source", f"open source (?:software )?{_LICENSE}"),
    ("open-source", f"free software {_LICENSE}"),
    ("non-commercial", "(?:for )?(?:noncommercial|non commercial) (?:use|purposes?) only"),
    ("non-commercial", "personal (?:and )?non commercial use"),
    ("research-only", "(?:for )?(?:academic|research) (?:use|purposes?) only"),
    ("attribution", "must (?:give|provide) (?:appropriate )?(?:credit|attribution)"),
    ("no-ai-training", "may not be used (?:to|for) (?:the )?train(?:ing)?(?: of)?(?: \\S+){0,6} (?:models?|ai|intelligence)"),
    ("no-ai-training", "(?:no|without) (?:text and )?data mining"),
    ("warranty", "without warrant(?:y|ies) of any kind"),
    ("warranty", "as is without (?:any )?(?:express|implied|warrant(?:y|ies))"),
    ("terms-of-use", "subject to (?:the|our|these) terms (?:of (?:use|service)|and conditions)"),
]

_WEIGHTS = {TEXT: 0.97, NOTICE: 0.9, NAME: 0.75, HINT: 0.4}
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    """``pattern`` over words; a rule is tried where a text has all its ``keywords``."""

    label: str
    pattern: str
    priority: int
    weight: float
    base: bool = False

    @property
    def keywords(self) -> list[str]:
        """Words that every match has: the plain words outside groups, the longest first."""
        plain, before = self.pattern, None
        while plain != before:  # innermost groups first; one that ends in a blank leaves a whole word after it
            before = plain
            plain = re.sub(r"\(\?:([^()]*)\)([?*]|\{[^}]*\})?", _without_group, plain)
        words = {w for w in plain.split(" ") if re.fullmatch("[a-z0-9]+", w)}
        return sorted(words, key=lambda w: (-len(w), w))

    @property
    def expression(self) -> str:
        """The pattern over a text in which each word has a blank of its own on both sides; group 1 is the match."""
        return " (" + self.pattern.replace(" ", "  ") + ") "


def _without_group(match: re.Match) -> str:
    parts = match[1].split("|")
    before = " " if all(p.startswith(" ") for p in parts) else "#"
    after = " " if all(p.endswith(" ") for p in parts) else "#"
    return before + after if before != after else before


def _words(label: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", label))


def all_rules() -> list[Rule]:
    """All rules in order of priority; within one priority as in the tables."""
    names = list(_NAMES)
    for elements, words in _COMMONS.items():
        short = _words(elements)
        for version in _COMMONS_VERSIONS:
            number = _words(version)
            names.append((f"cc-{elements}-{version}", [
                f"cc {short} {_V}{number}",
                f"creative commons {words} {_V}{number}(?: (?:international|unported|generic))?",
                f"creativecommons org licenses {short} {number}"]))
        names.append((f"cc-{elements}", [f"creative commons {words}", f"creativecommons org licenses {short}"]
                      + ([f"cc {short}"] if elements != "by" else [])))
    rules = [Rule(label, sentence, TEXT, _WEIGHTS[TEXT]) for label, sentence in _SENTENCES]
    rules += [Rule(label, f"spdx license identifier {_words(label)}", TEXT, 0.99) for label, _ in names]
    rules += [Rule(label, f"{_UNDER}{name}", NOTICE, _WEIGHTS[NOTICE]) for label, found in names for name in found]
    rules += [Rule(label, name, NAME, _WEIGHTS[NAME]) for label, found in names for name in found]
    rules += [Rule(label, phrase, HINT, BASE_WEIGHT, True) for phrase, label in BASE_PHRASES]
    return rules + [Rule(label, phrase, HINT, _WEIGHTS[HINT]) for label, phrase in _HINTS]
