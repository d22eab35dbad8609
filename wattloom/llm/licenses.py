"""License scans with DataFrame functions only: ordered signature rules gated by keywords.

A text is lower-cased (A-Z) and reduced to its words, runs of ASCII digits, letters and non-ASCII
characters, each set between blanks: ' gnu  general  public  license '. Rules are regular expressions over
that form. A rule is tried only where its keyword occurs; the keywords are looked for once in each text. Each match is
an interval of characters; one that lies within another is suppressed, of equal intervals the rule that stands
first in RULES stays.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tasks import id_and_text

#: Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_NOT_WORD = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    score: float


#: Short forms in patterns: license, a grant's words before a name, a version after it, SPDX's tag.
SHORT = {
    "<l>": "licen[cs]e",
    "<u>": "(?:licensed |released |distributed |available |provided |published |covered )?(?:under|by|subject to)(?: the)?(?: terms of)?(?: the)? ",
    "<v>": "(?: version| v)? v?[0-9]+(?: [0-9]+)*(?: (?:only|or later|or any later version|international|unported|generic))*",
    "<s>": "spdx <l> identifier ",
}
#: Rules in order of priority: label, score, keyword, and a regular expression over single-spaced words. Each match holds the keyword.
RULES = """
mit            1.0  hereby          permission is hereby granted free of charge to any person obtaining a copy
mit            0.9  deal in         to deal in the software without restriction
mit-0          1.0  <s>             <s>mit 0
mit            1.0  <s>             <s>mit
x11            1.0  <s>             <s>x11
isc            1.0  and or          permission to use copy modify and or distribute this software for any purpose
isc            1.0  <s>             <s>isc
0bsd           1.0  <s>             <s>0bsd
bsd-2-clause   1.0  <s>             <s>bsd 2 clause
bsd-3-clause   1.0  <s>             <s>bsd 3 clause
bsd-4-clause   1.0  <s>             <s>bsd 4 clause
bsd            1.0  redistribution  redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause   0.9  contributors    neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|their) contributors may be used
bsd-4-clause   0.9  advertising     all advertising materials mentioning features or use of this software must display
apache         1.0  compliance      you may not use this file except in compliance with the <l>
apache         1.0  <s>             <s>apache [0-9]+ [0-9]+
lgpl           1.0  <s>             <s>lgpl [0-9]+ [0-9]+(?: only| or later)?
agpl           1.0  <s>             <s>agpl [0-9]+ [0-9]+(?: only| or later)?
gpl            1.0  <s>             <s>gpl [0-9]+ [0-9]+(?: only| or later)?(?: with [^ ]+(?: [^ ]+)? exception)?
gfdl           1.0  <s>             <s>gfdl [0-9]+ [0-9]+(?: (?:no )?invariants)?(?: only| or later)?
mpl            1.0  <s>             <s>mpl [0-9]+ [0-9]+(?: no copyleft exception)?
epl            1.0  <s>             <s>epl [0-9]+ [0-9]+
cddl           1.0  <s>             <s>cddl [0-9]+ [0-9]+
cpl            1.0  <s>             <s>cpl 1 0
eupl           1.0  <s>             <s>eupl [0-9]+ [0-9]+
artistic       1.0  <s>             <s>artistic [0-9]+ [0-9]+(?: perl)?
zlib           1.0  <s>             <s>zlib
boost          1.0  <s>             <s>bsl 1 0
bsl            1.0  <s>             <s>busl 1 1
wtfpl          1.0  <s>             <s>wtfpl
unlicense      1.0  <s>             <s>unlicense
python         1.0  <s>             <s>(?:python|psf) 2 0
php            1.0  <s>             <s>php 3 [0-9]+
ruby           1.0  <s>             <s>ruby
postgresql     1.0  <s>             <s>postgresql
openssl        1.0  <s>             <s>openssl
ofl            1.0  <s>             <s>ofl 1 [01]
odbl           1.0  <s>             <s>odbl 1 0
odc-by         1.0  <s>             <s>odc by 1 0
pddl           1.0  <s>             <s>pddl 1 0
ms-pl          1.0  <s>             <s>ms pl
ms-rl          1.0  <s>             <s>ms rl
apsl           1.0  <s>             <s>apsl [0-9]+ [0-9]+
osl            1.0  <s>             <s>osl [0-9]+ [0-9]+
afl            1.0  <s>             <s>afl [0-9]+ [0-9]+
ncsa           1.0  <s>             <s>ncsa
vim            1.0  <s>             <s>vim
cecill         1.0  <s>             <s>cecill [0-9bc]+(?: [0-9]+)?
mulan          1.0  <s>             <s>mulanpsl [0-9]+ [0-9]+
sspl           1.0  <s>             <s>sspl 1 0
elastic        1.0  <s>             <s>elastic 2 0
hpnd           1.0  <s>             <s>hpnd
ecl            1.0  <s>             <s>ecl [0-9]+ [0-9]+
upl            1.0  <s>             <s>upl 1 0
blueoak        1.0  <s>             <s>blueoak 1 0 0
cc0            1.0  <s>             <s>cc0 1 0
cc-by-nc-nd    1.0  <s>             <s>cc by nc nd [0-9]+ [0-9]+
cc-by-nc-sa    1.0  <s>             <s>cc by nc sa [0-9]+ [0-9]+
cc-by-nc       1.0  <s>             <s>cc by nc [0-9]+ [0-9]+
cc-by-nd       1.0  <s>             <s>cc by nd [0-9]+ [0-9]+
cc-by-sa       1.0  <s>             <s>cc by sa [0-9]+ [0-9]+
cc-by          1.0  <s>             <s>cc by [0-9]+ [0-9]+
lgpl           1.0  lesser          redistribute it and or modify it under the terms of the gnu lesser general public <l>
lgpl           1.0  library         redistribute it and or modify it under the terms of the gnu library general public <l>
agpl           1.0  affero          redistribute it and or modify it under the terms of the gnu affero general public <l>
gpl            1.0  redistribute    redistribute it and or modify it under the terms of the gnu general public <l>
gfdl           1.0  documentation   permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <l>
gfdl           0.9  invariant       with no invariant sections no front cover texts and no back cover texts
mpl            1.0  source code form  this source code form is subject to the terms of the mozilla public <l>
zlib           0.9  as is           this software is provided as is without any express or implied warranty
boost          1.0  reproduce       to use reproduce display distribute execute and transmit the software
unlicense      1.0  unencumbered    this is free and unencumbered software released into the public domain
wtfpl          1.0  you want to     you just do what the fuck you want to
cc-by-nc-nd    0.95 no  deriv       creative commons attribution non ?commercial no deriv(?:s|atives)(?: works)?(?: <l>)?(?:<v>)?(?: <l>)?
cc-by-nc-nd    0.95 noderiv         creative commons attribution non ?commercial noderiv(?:s|atives)(?:<v>)?(?: <l>)?
cc-by-nc-sa    0.95 share           creative commons attribution non ?commercial share ?alike(?: <l>)?(?:<v>)?(?: <l>)?
cc-by-sa       0.95 share           creative commons attribution share ?alike(?: <l>)?(?:<v>)?(?: <l>)?
cc-by-nd       0.95 no  deriv       creative commons attribution no deriv(?:s|atives)(?: works)?(?: <l>)?(?:<v>)?(?: <l>)?
cc-by-nd       0.95 noderiv         creative commons attribution noderiv(?:s|atives)(?:<v>)?(?: <l>)?
cc-by-nc       0.95 commercial      creative commons attribution non ?commercial(?: <l>)?(?:<v>)?(?: <l>)?
cc-by          0.95 attribution     creative commons attribution(?: <l>)?(?:<v>)?(?: <l>)?
cc0            0.95 cc0             <u>cc0(?:<v>)?(?: universal)?
cc0            0.9  zero            creative commons zero(?:<v>)?(?: universal)?
cc0            0.85 cc0             cc0(?:<v>)?(?: universal)?(?: public domain dedication)?
cc-by-nc-nd    0.95 nc  nd          <u>cc by nc nd(?:<v>)?
cc-by-nc-sa    0.95 nc  sa          <u>cc by nc sa(?:<v>)?
cc-by-nc       0.95 by  nc          <u>cc by nc(?:<v>)?
cc-by-nd       0.95 by  nd          <u>cc by nd(?:<v>)?
cc-by-sa       0.95 by  sa          <u>cc by sa(?:<v>)?
cc-by          0.95 cc  by          <u>cc by(?:<v>)?
cc-by-nc-nd    0.85 nc  nd          cc by nc nd(?:<v>)?
cc-by-nc-sa    0.85 nc  sa          cc by nc sa(?:<v>)?
cc-by-nc       0.85 by  nc          cc by nc(?:<v>)?
cc-by-nd       0.85 by  nd          cc by nd(?:<v>)?
cc-by-sa       0.85 by  sa          cc by sa(?:<v>)?
cc-by          0.85 cc  by          cc by<v>
lgpl           0.95 lesser          <u>gnu lesser general public <l>(?:<v>)?
lgpl           0.95 library         <u>gnu library general public <l>(?:<v>)?
lgpl           0.95 lgpl            <u>(?:gnu )?lgpl(?:<v>)?
agpl           0.95 affero          <u>gnu affero general public <l>(?:<v>)?
agpl           0.95 agpl            <u>(?:gnu )?agpl(?:<v>)?
gpl            0.95 gnu             <u>gnu general public <l>(?:<v>)?
gpl            0.95 gpl             <u>(?:gnu )?gpl(?:<v>)?
gpl            0.85 gnu             gnu general public <l><v>
gpl            0.85 gpl             gpl ?v?[0-9]+(?: [0-9]+)?(?: or later| only)?
gpl            0.6  gnu             gnu general public <l>
gpl            0.6  gpl             (?:gnu )?gpl
lgpl           0.85 lesser          gnu lesser general public <l>(?:<v>)?
lgpl           0.85 library         gnu library general public <l>(?:<v>)?
lgpl           0.85 lgpl            lgpl ?v?[0-9]+(?: [0-9]+)?
lgpl           0.6  lgpl            (?:gnu )?lgpl
agpl           0.85 affero          (?:gnu )?affero general public <l>(?:<v>)?
agpl           0.85 agpl            agpl ?v?[0-9]+(?: [0-9]+)?
agpl           0.6  agpl            (?:gnu )?agpl
gfdl           0.95 documentation   <u>gnu free documentation <l>(?:<v>)?
gfdl           0.85 documentation   gnu free documentation <l>(?:<v>)?
gfdl           0.6  gfdl            gfdl(?:<v>)?
apache         0.95 apache          <u>apache (?:software )?<l>(?:<v>)?
apache         0.95 apache          <u>apache<v>(?: <l>)?
apache         0.85 apache          apache (?:software )?<l><v>
apache         0.85 apache          apache 2(?: 0)?
apache         0.6  apache          apache (?:software )?<l>
mit            0.95 mit             <u>(?:mit|expat) <l>
mit            0.95 mit  lic        mit licensed
mit            0.6  mit  lic        mit <l>
mit            0.6  expat           expat <l>
x11            0.95 x11             <u>x11 <l>
x11            0.6  x11             x11 <l>
bsd-2-clause   0.95 clause          (?:simplified |freebsd )?bsd 2 clause(?: <l>)?
bsd-2-clause   0.95 clause          (?:2|two) clause bsd(?: <l>)?
bsd-3-clause   0.95 clause          (?:new |revised |modified )?bsd 3 clause(?: <l>)?
bsd-3-clause   0.95 clause          (?:3|three) clause bsd(?: <l>)?
bsd-4-clause   0.95 clause          (?:original )?bsd 4 clause(?: <l>)?
bsd            0.95 bsd             <u>(?:new |revised |simplified |modified )?bsd <l>
bsd            0.6  bsd             (?:new |revised |simplified |modified )?bsd <l>
0bsd           0.85 0bsd            0bsd(?: <l>)?
isc            0.95 isc             <u>isc <l>
isc            0.6  isc             isc <l>
isc            0.85 consortium      internet (?:systems|software) consortium <l>
mpl            0.95 mozilla         <u>mozilla public <l>(?:<v>)?
mpl            0.95 mpl             <u>mpl(?:<v>)?
mpl            0.85 mozilla         mozilla public <l>(?:<v>)?
mpl            0.85 mpl             mpl<v>
mpl            0.6  mpl             mpl
epl            0.95 eclipse         <u>eclipse public <l>(?:<v>)?
epl            0.85 eclipse         eclipse public <l>(?:<v>)?
epl            0.85 epl             epl<v>
cddl           0.95 development     <u>common development and distribution <l>(?:<v>)?
cddl           0.85 development     common development and distribution <l>(?:<v>)?
cddl           0.85 cddl            cddl<v>
cddl           0.6  cddl            cddl
cpl            0.85 common  public  common public <l>(?:<v>)?
eupl           0.85 european        european union public <l>(?:<v>)?
eupl           0.85 eupl            eupl<v>
eupl           0.6  eupl            eupl
artistic       0.85 artistic        (?:perl )?artistic <l>(?:<v>)?
zlib           0.85 zlib            zlib (?:libpng )?<l>
boost          0.85 boost           boost software <l>(?:<v>)?
wtfpl          0.85 wtfpl           wtfpl(?:<v>)?
wtfpl          0.85 fuck            do what the fuck you want to public <l>(?:<v>)?
unlicense      0.85 unlicense       the unlicense
unlicense      0.85 unlicense       <u>unlicense
python         0.85 python          python software foundation <l>(?:<v>)?
python         0.85 psf             psf <l>(?:<v>)?
php            0.85 php             php <l>(?:<v>)?
ruby           0.85 ruby            ruby <l>
postgresql     0.85 postgresql      postgresql <l>
openssl        0.85 openssl         openssl <l>
ofl            0.85 open  font      (?:sil )?open font <l>(?:<v>)?
odbl           0.85 database        open (?:data commons open )?database <l>(?:<v>)?
odbl           0.85 odbl            odbl(?:<v>)?
odc-by         0.85 data  commons   open data commons attribution <l>(?:<v>)?
odc-by         0.6  odc  by         odc by(?:<v>)?
pddl           0.85 dedication      (?:open data commons )?public domain dedication and <l>(?:<v>)?
pddl           0.6  pddl            pddl(?:<v>)?
ogl            0.85 government      open government <l>(?:<v>)?
ms-pl          0.85 microsoft       microsoft public <l>
ms-pl          0.6  ms  pl          ms pl
ms-rl          0.85 microsoft       microsoft reciprocal <l>
ms-rl          0.6  ms  rl          ms rl
apsl           0.85 apple           apple public source <l>(?:<v>)?
apsl           0.6  apsl            apsl(?:<v>)?
osl            0.85 open  software  open software <l>(?:<v>)?
afl            0.85 academic        academic free <l>(?:<v>)?
qpl            0.85 q  public       q public <l>(?:<v>)?
ncsa           0.85 ncsa            (?:university of illinois )?ncsa (?:open source )?<l>
vim            0.85 vim             vim <l>
cecill         0.85 cecill          cecill(?: [abc])?(?: v?[0-9]+(?: [0-9]+)?)?
mulan          0.85 mulan           mulan (?:permissive software |public )?<l>(?:<v>)?
bsl            0.85 business        business source <l>(?:<v>)?
sspl           0.85 server          server side public <l>(?:<v>)?
sspl           0.6  sspl            sspl(?:<v>)?
elastic        0.85 elastic         elastic <l>(?:<v>)?
openrail       0.85 rail            (?:creativeml |bigscience )?(?:bigcode )?open ?rail(?: m)?(?: <l>)?
llama          0.85 llama           llama [0-9]+(?: [0-9]+)? community <l>
gemma          0.85 gemma           gemma terms of use
ecl            0.85 educational     educational community <l>(?:<v>)?
upl            0.85 permissive      universal permissive <l>(?:<v>)?
hpnd           0.85 permission      historical permission notice and disclaimer
w3c            0.85 w3c             w3c software (?:notice and )?<l>
ijg            0.85 jpeg            independent jpeg group(?: s)? <l>
freetype       0.85 freetype        freetype (?:project )?<l>
latex          0.85 latex           latex project public <l>(?:<v>)?
beerware       0.85 beer            beer ?ware <l>
json           0.85 for  good       the software shall be used for good not evil
commons-clause 0.85 clause          commons clause(?: <l>)?(?: condition)?(?:<v>)?
polyform       0.85 polyform        polyform (?:noncommercial|small business|shield|strict|perimeter) <l>(?:<v>)?
parity         0.85 parity          parity public <l>(?:<v>)?
open-font      0.6  font  embed     font embedding <l>
public-domain  0.8  public  domain  (?:dedicated to|released into|placed in|in) the public domain
public-domain  0.4  public  domain  public domain
all-rights-reserved 0.7 reserved    (?:copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6})?all rights reserved
some-rights-reserved 0.6 reserved   some rights reserved
proprietary    0.8  proprietary     proprietary and confidential
proprietary    0.8  unauthori       unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? (?:of this (?:file|document|software) )?is (?:strictly )?prohibited
proprietary    0.7  trade  secret   contains trade secrets
proprietary    0.7  written         without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)
eula           0.8  end  user       end user <l> agreement
eula           0.7  eula            eula
copyright      0.5  copyright       copyright (?:c )?[0-9]{4}(?: [0-9]{4})*
warranty-disclaimer 0.6 warrant     without (?:any )?warrant(?:y|ies) (?:or conditions )?of any kind
warranty-disclaimer 0.6 fitness     merchantability (?:and|or) fitness for a particular purpose
liability-disclaimer 0.6 liable     in no event shall (?:[^ ]+ ){1,8}be liable
non-commercial 0.6  commercial      for non ?commercial (?:use|purposes)(?: only)?
research-only  0.6  research        for research (?:use|purposes) only
no-derivatives 0.6  derivative      no derivative works
attribution-required 0.5 attribution  attribution (?:is )?required
"""


def _spaced(words: str) -> str:
    """A pattern over single-spaced words as one over words that each stand between blanks of their own."""
    return words.replace(" ", "  ").replace("[^  ]", "[^ ]").replace("  ?", "(?:  )?")


def rules() -> list[Rule]:
    """All rules in order of priority."""
    out = []
    for i, line in enumerate(RULES.strip().splitlines()):
        label, score, rest = line.split(maxsplit=2)
        keyword, pattern = re.split(r" {2,}(?=[^ ]+(?: [^ ]+)*$)", rest, maxsplit=1)
        for short, words in reversed(SHORT.items()):
            pattern = pattern.replace(short, words)
        out.append(Rule(label, i, "spdx" if keyword == "<s>" else re.sub(" +", "  ", keyword), f" {_spaced(pattern)} ", float(score)))
    return out


def _norm(text: Column) -> Column:
    """Blank, words each followed by a blank; one more blank between words comes with ``_doubled``."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _NOT_WORD, _LOWER + " " * len(_NOT_WORD))
    return F.trim(F.regexp_replace(plain, "  +", " "))


def _places(norm: Column) -> Column:
    """All places of base phrases: (word, label). Split by a phrase, the parts before a place tell its word."""
    found = []
    for phrase, label in BASE.items():
        spaced = " " + phrase.replace(" ", "  ") + " "
        words = len(phrase.split(" "))
        # words before place i: those of the first i+1 parts and of the i phrases before it
        parts = F.transform(F.split(norm, F.lit(spaced), -1), lambda p: ((F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))) / 2).cast("long"))
        places = (F.size(parts) - 1).cast("long")
        last = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(0).cast("long"), lambda a, n: a + n) + (places - 1) * words
        found.append(F.when(F.contains(norm, F.lit(spaced)), F.struct(parts[0].alias("first"), last.alias("last"), places.alias("n"), F.lit(label).alias("label"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _hits(norm: Column, pattern: Column) -> Column:
    """Every match of a pattern: (gap, hit), characters between it and the match before, and its own; in one pass of the pattern."""
    pieces = F.split(F.regexp_replace(norm, pattern, F.lit("\x01$0\x02")), F.lit("\x02"), -1)
    marked = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(marked, lambda p: F.struct((F.instr(p, F.lit("\x01")) - 1).alias("gap"), (F.length(p) - F.instr(p, F.lit("\x01"))).alias("hit")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detections: bool = False) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest
    word at which one starts (null: none). labels joins the base labels with those of the rules' surviving
    detections, score is the best of their scores (base: 0.6 at least; none: 0). A null text counts as
    empty. Null ids and repeated rows are returned as they come; other columns are dropped; an empty table
    gives no rows. With ``detections`` the survivors themselves: (doc_id, start, end, label, priority, score), where
    start and end are characters of the reduced text.
    """
    every = rules()
    words = id_and_text(docs, id_col, text_col).select("doc_id", _norm(F.col("text")).alias("words"))
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    x = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_words"), F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("norm"))
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in every})])
    x = x.select("row", "doc_id", "n_words", "norm", F.filter(keywords, lambda k: F.contains(F.col("norm"), k)).alias("there"))
    table = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score")) for r in every])
    none = F.array().cast("array<struct<keyword:string,pattern:string,priority:int,label:string,score:double>>")
    tried = F.when(F.size("there") > 0, F.filter(table, lambda r: F.array_contains(F.col("there"), r["keyword"]))).otherwise(none)
    x = x.select("row", "doc_id", "n_words", _places(F.col("norm")).cast("array<struct<first:bigint,last:bigint,n:bigint,label:string>>").alias("base"), "norm", F.explode_outer(tried).alias("r"))
    x = x.select("row", "doc_id", "n_words", "base", "r.priority", "r.label", "r.score", F.posexplode_outer(_hits(F.col("norm"), F.col("r.pattern"))).alias("at", "d"))
    # one shuffle serves the windows and the group
    x = x.repartition("row")
    run = W.partitionBy("row", "priority").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("end", F.sum(F.col("d.gap") + F.col("d.hit")).over(run)).withColumn("start", F.col("end") - F.col("d.hit"))
    before = W.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.desc("end"), "priority").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("stays", F.col("d").isNotNull() & F.coalesce(F.max("end").over(before) < F.col("end"), F.lit(True)))
    if detections:
        return x.where("stays").select("doc_id", F.col("start").cast("int"), F.col("end").cast("int"), "label", "priority", "score")
    g = x.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.collect_set(F.when(F.col("stays"), F.col("label"))).alias("more"), F.max(F.when(F.col("stays"), F.col("score"))).alias("best"))
    labels = F.transform(F.col("base"), lambda b: b["label"])
    none = F.size("base") == 0
    total = F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    return g.select(
        "doc_id", "n_words", total.alias("n_base"),
        F.when(~none, F.array_min(F.transform("base", lambda b: b["first"]))).alias("first_word"),
        F.when(~none, F.array_max(F.transform("base", lambda b: b["last"]))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(labels, F.col("more")))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(none, 0.0).otherwise(0.6)).alias("score"),
    )
