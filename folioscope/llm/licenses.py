"""License scans by ordered signature rules.

Some 320 rules are written by hand, some hundreds more are the forms in which families are
referred to by name. A rule is a regular expression over the lower-cased bytes of a text, with a
label, a priority and a keyword that must occur before the expression is tried. Keywords of all rules
are found in one pass by an Aho-Corasick automaton; most texts hold none and are done. Of
overlapping detections one that lies within another of higher priority (or of the same
priority and greater length) is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import ship

#: A word: digits, letters a-z and every character outside ASCII.
WORD = rb"[0-9a-z\x80-\xff]+"
#: Fixed values of the base rules: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The signature rules, written by hand and in order: label, priority (0 to 100), keyword, expression. A
#: space in an expression stands for whatever separates two words.
SIGNATURES = r"""
# apache
apache-2.0 95 apache spdx license identifier apache 2 0
apache-2.0 80 apache licensed under the apache license version 2 0
apache-2.0 75 apache apache (?:software )?licen[sc]e,? (?:version |v )?2(?: 0)?
apache-2.0 75 apache www apache org licenses license 2 0
apache-2.0 60 apache (?:under|with|by) (?:the )?apache 2(?: 0)?
apache-2.0 45 apache apache ?2 0 licen[sc]ed?
apache-1.1 75 apache apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1.1 90 apache spdx license identifier apache 1 1
apache-1.0 75 apache apache (?:software )?licen[sc]e (?:version |v )?1 0
apache-1.0 70 apache this product includes software developed by the apache group
apache-1.1 72 apache this product includes software developed by the apache software foundation
apache 50 apache apache (?:software )?licen[sc]e
apache 55 apache (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache licen[sc]e
# mit and its relatives
mit 95 mit spdx license identifier mit
mit 70 mit (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[sc]e
mit 55 mit (?:the )?mit licen[sc]e(?: mit)?
mit 55 mit (?:the )?mit x11 licen[sc]e
mit 55 expat (?:the )?expat licen[sc]e
mit 45 mit mit licensed
mit 40 mit licen[sc]e mit
mit 65 hereby permission is hereby granted free of charge to any person obtaining a copy of this software
mit 60 notice the above copyright notice and this permission notice shall be included in all copies
mit-0 90 mit spdx license identifier mit 0
mit-0 75 mit mit no attribution(?: licen[sc]e)?
x11 85 x11 spdx license identifier x11
x11 60 x11 (?:the )?x11 licen[sc]e
x11 65 consortium except as contained in this notice the name of the x consortium shall not be used
permissive 50 hereby permission is hereby granted free of charge
isc 95 isc spdx license identifier isc
isc 60 isc (?:the )?isc licen[sc]e
isc 65 copy permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee
ntp 62 copy permission to use copy modify and distribute this software and its documentation for any purpose
curl 85 curl spdx license identifier curl
curl 55 curl (?:the )?curl licen[sc]e
unlicense 95 unlicense spdx license identifier unlicense
unlicense 60 unlicense (?:the )?unlicense
unlicense 70 unencumbered this is free and unencumbered software released into the public domain
0bsd 95 0bsd spdx license identifier 0bsd
0bsd 75 bsd (?:zero clause|0 clause) bsd(?: licen[sc]e)?
wtfpl 90 wtfpl spdx license identifier wtfpl
wtfpl 60 wtfpl (?:the )?wtfpl(?: licen[sc]e)?
wtfpl-2 75 wtfpl wtfpl (?:version |v )?2
wtfpl 70 fuck do what the fuck you want to public licen[sc]e
zlib 95 zlib spdx license identifier zlib
zlib 60 zlib (?:the )?zlib(?: libpng)? licen[sc]e
zlib 65 misrepresented the origin of this software must not be misrepresented
zlib 62 altered altered source versions must be plainly marked as such
libpng 60 libpng (?:the )?libpng licen[sc]e
beerware 75 beer (?:the )?beer ?ware licen[sc]e
beerware 70 beer you can buy me a beer in return
# bsd
bsd-2-clause 95 bsd spdx license identifier bsd 2 clause
bsd-3-clause 95 bsd spdx license identifier bsd 3 clause
bsd-4-clause 95 bsd spdx license identifier bsd 4 clause
bsd-2-clause 75 bsd (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause 75 bsd (?:3|three) clause bsd(?: licen[sc]e)?
bsd-4-clause 75 bsd (?:4|four) clause bsd(?: licen[sc]e)?
bsd-2-clause 74 bsd bsd (?:2|two) clause(?: licen[sc]e)?
bsd-3-clause 74 bsd bsd (?:3|three) clause(?: licen[sc]e)?
bsd-4-clause 74 bsd bsd (?:4|four) clause(?: licen[sc]e)?
bsd-2-clause 70 bsd (?:simplified|freebsd) bsd licen[sc]e
bsd-2-clause 70 freebsd (?:the )?freebsd licen[sc]e
bsd-3-clause 70 bsd (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause 70 bsd (?:original|old) bsd licen[sc]e
bsd 55 bsd bsd style licen[sc]e
bsd 52 bsd (?:the )?bsd licen[sc]e
bsd 60 bsd (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd licen[sc]e
bsd 62 redistribution redistribution and use in source and binary forms(?: with or without modification)? are permitted
permissive 50 redistribution redistribution and use in source and binary forms
bsd-3-clause 66 endorse neither the name of .{0,80}? may be used to endorse or promote products
bsd-4-clause 67 advertising all advertising materials mentioning features or use of this software must display
# gnu general public licenses
gpl-3 95 gpl spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 95 gpl spdx license identifier gpl 2 0(?: only| or later)?
gpl-1 95 gpl spdx license identifier gpl 1 0(?: only| or later)?
gpl-3 78 general gnu general public licen[sc]e,? (?:version |v )?3(?: 0)?
gpl-2 78 general gnu general public licen[sc]e,? (?:version |v )?2(?: 0)?
gpl-1 78 general gnu general public licen[sc]e,? (?:version |v )?1(?: 0)?
gpl-3 72 gpl (?:gnu )?gpl ?(?:version |v )?3(?: 0)?
gpl-2 72 gpl (?:gnu )?gpl ?(?:version |v )?2(?: 0)?
gpl-3 70 gplv3 (?:gnu )?gplv3
gpl-2 70 gplv2 (?:gnu )?gplv2
gpl-2 74 general general public licen[sc]e as published by the free software foundation either version 2
gpl-3 74 general general public licen[sc]e as published by the free software foundation either version 3
gpl 68 general (?:under the terms of|subject to) the gnu general public licen[sc]e
gpl 60 general gnu general public licen[sc]e
gpl 52 gpl (?:the )?gnu gpl
gpl 50 gpl gpl licen[sc]ed?
gpl 58 general licensed under the (?:gnu )?general public licen[sc]e
gpl-exception 66 gpl gpl with (?:the )?(?:classpath|linking|runtime library) exception
gpl-exception 80 classpath classpath exception 2 0
# lesser, library, affero, documentation
lgpl-3 95 lgpl spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 95 lgpl spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2 95 lgpl spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-3 80 lesser (?:gnu )?lesser general public licen[sc]e,? (?:version |v )?3(?: 0)?
lgpl-2.1 80 lesser (?:gnu )?lesser general public licen[sc]e,? (?:version |v )?2 1
lgpl-2 80 library (?:gnu )?library general public licen[sc]e,? (?:version |v )?2(?: 0)?
lgpl-3 73 lgpl (?:gnu )?lgpl ?(?:version |v )?3(?: 0)?
lgpl-2.1 73 lgpl (?:gnu )?lgpl ?(?:version |v )?2 1
lgpl-2 71 lgpl (?:gnu )?lgpl ?(?:version |v )?2
lgpl-3 70 lgplv3 (?:gnu )?lgplv3
lgpl-2.1 70 lgplv2 (?:gnu )?lgplv2 1
lgpl 66 lesser (?:gnu )?lesser general public licen[sc]e
lgpl 65 library gnu library general public licen[sc]e
lgpl 50 lgpl (?:gnu )?lgpl(?: licen[sc]ed?)?
agpl-3 95 agpl spdx license identifier agpl 3 0(?: only| or later)?
agpl-1 95 agpl spdx license identifier agpl 1 0(?: only| or later)?
agpl-3 82 affero (?:gnu )?affero general public licen[sc]e,? (?:version |v )?3(?: 0)?
agpl-1 81 affero affero general public licen[sc]e,? (?:version |v )?1(?: 0)?
agpl-3 73 agpl (?:gnu )?agpl ?(?:version |v )?3(?: 0)?
agpl-3 70 agplv3 (?:gnu )?agplv3
agpl 68 affero (?:gnu )?affero general public licen[sc]e
agpl 50 agpl (?:gnu )?agpl(?: licen[sc]ed?)?
gfdl-1.1 80 documentation gnu free documentation licen[sc]e,? (?:version |v )?1 1
gfdl-1.2 80 documentation gnu free documentation licen[sc]e,? (?:version |v )?1 2
gfdl-1.3 80 documentation gnu free documentation licen[sc]e,? (?:version |v )?1 3
gfdl-1.3 95 gfdl spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 95 gfdl spdx license identifier gfdl 1 2(?: only| or later)?
gfdl 60 documentation gnu free documentation licen[sc]e
gfdl 50 gfdl (?:gnu )?(?:gfdl|g f d l)
gnu-all-permissive 62 copying copying and distribution of this file with or without modification are permitted
# weak copyleft and corporate
mpl-2.0 95 mpl spdx license identifier mpl 2 0
mpl-1.1 95 mpl spdx license identifier mpl 1 1
mpl-1.0 95 mpl spdx license identifier mpl 1 0
mpl-2.0 78 mozilla mozilla public licen[sc]e,? (?:version |v )?2 0
mpl-1.1 78 mozilla mozilla public licen[sc]e,? (?:version |v )?1 1
mpl-1.0 78 mozilla mozilla public licen[sc]e,? (?:version |v )?1 0
mpl-2.0 70 mpl mpl ?(?:version |v )?2 0
mpl-1.1 70 mpl mpl ?(?:version |v )?1 1
mpl-2.0 76 mozilla subject to the terms of the mozilla public licen[sc]e v 2 0
mpl 60 mozilla mozilla public licen[sc]e
npl-1.1 75 netscape netscape public licen[sc]e,? (?:version |v )?1 1
npl 60 netscape netscape public licen[sc]e
epl-2.0 95 epl spdx license identifier epl 2 0
epl-1.0 95 epl spdx license identifier epl 1 0
epl-2.0 78 eclipse eclipse public licen[sc]e,? (?:version |v )?2 0
epl-1.0 78 eclipse eclipse public licen[sc]e,? (?:version |v )?1 0
epl 60 eclipse eclipse public licen[sc]e
edl 62 eclipse eclipse distribution licen[sc]e
cpl-1.0 78 common common public licen[sc]e,? (?:version |v )?1 0
cpl 55 common common public licen[sc]e
ipl-1.0 75 ibm ibm public licen[sc]e(?: (?:version |v )?1 0)?
cddl-1.1 78 cddl cddl ?(?:version |v )?1 1
cddl-1.0 78 cddl cddl ?(?:version |v )?1 0
cddl-1.0 80 common common development and distribution licen[sc]e,? (?:version |v )?1 0
cddl-1.1 80 common common development and distribution licen[sc]e,? (?:version |v )?1 1
cddl 62 common common development and distribution licen[sc]e
cddl 50 cddl cddl(?: licen[sc]ed?)?
eupl-1.2 80 eupl eupl ?(?:version |v )?1 2
eupl-1.1 80 eupl eupl ?(?:version |v )?1 1
eupl 62 european european union public licen[sc]e
eupl 50 eupl eupl(?: licen[sc]ed?)?
cecill-2.1 78 cecill cecill(?: free software licen[sc]e agreement)? (?:version |v )?2 1
cecill-b 76 cecill cecill b
cecill-c 76 cecill cecill c
cecill 55 cecill cecill(?: licen[sc]e)?
artistic-2.0 90 artistic spdx license identifier artistic 2 0
artistic-2.0 75 artistic artistic licen[sc]e,? (?:version |v )?2 0
artistic-1.0 75 artistic artistic licen[sc]e,? (?:version |v )?1 0
artistic 55 artistic (?:the )?(?:clarified )?artistic licen[sc]e
perl 60 perl (?:under the )?same terms as perl itself
psf-2.0 78 python python software foundation licen[sc]e,? (?:version |v )?2
psf 60 python (?:python software foundation|psf) licen[sc]e
ruby 60 ruby (?:the )?ruby(?: s)? licen[sc]e
php-3.01 75 php php licen[sc]e,? (?:version |v )?3 01
php 55 php (?:the )?php licen[sc]e
lppl-1.3c 78 latex latex project public licen[sc]e,? (?:version |v )?1 3c?
lppl 62 latex latex project public licen[sc]e
lppl 50 lppl (?:the )?lppl
ofl-1.1 95 ofl spdx license identifier ofl 1 1
ofl-1.1 78 sil sil open font licen[sc]e,? (?:version |v )?1 1
ofl-1.0 78 sil sil open font licen[sc]e,? (?:version |v )?1 0
ofl 62 sil sil open font licen[sc]e
ofl 55 font (?:the )?open font licen[sc]e
bsl-1.0 95 bsl spdx license identifier bsl 1 0
bsl-1.0 75 boost boost software licen[sc]e(?: (?:version |v )?1 0)?
afl-3.0 75 academic academic free licen[sc]e,? (?:version |v )?3 0
afl-2.1 75 academic academic free licen[sc]e,? (?:version |v )?2 1
afl 60 academic academic free licen[sc]e
osl-3.0 75 licen open software licen[sc]e,? (?:version |v )?3 0
osl-2.1 75 licen open software licen[sc]e,? (?:version |v )?2 1
osl 60 licen open software licen[sc]e
ecl-2.0 70 educational educational community licen[sc]e(?: (?:version |v )?2 0)?
ncsa 65 ncsa (?:university of illinois )?ncsa open source licen[sc]e
ms-pl 70 microsoft microsoft public licen[sc]e
ms-rl 70 microsoft microsoft reciprocal licen[sc]e
ms-pl 90 spdx spdx license identifier ms pl
ms-rl 90 spdx spdx license identifier ms rl
ms-ltbsl 68 microsoft microsoft limited (?:public|reciprocal) licen[sc]e
upl-1.0 70 universal universal permissive licen[sc]e(?: (?:version |v )?1 0)?
openssl 62 openssl (?:the )?openssl licen[sc]e
openssl 66 openssl this product includes software developed by the openssl project
ssleay 62 ssleay (?:original )?ssleay licen[sc]e
qpl-1.0 70 public (?:the )?q public licen[sc]e(?: (?:version |v )?1 0)?
sleepycat 65 sleepycat (?:the )?sleepycat licen[sc]e
vim 55 vim (?:the )?vim licen[sc]e
w3c 62 w3c w3c software (?:notice and )?(?:and document )?licen[sc]e
unicode 62 unicode unicode (?:data files and software )?licen[sc]e(?: agreement)?
icu 60 icu icu licen[sc]e
mulan-2.0 72 mulan mulan (?:psl|permissive software licen[sc]e)(?: v ?2)?
blueoak-1.0 72 blue blue oak model licen[sc]e(?: 1 0 0)?
hippocratic 65 hippocratic (?:the )?hippocratic licen[sc]e
rpl-1.5 65 reciprocal reciprocal public licen[sc]e(?: 1 5)?
watcom 62 watcom sybase open watcom public licen[sc]e
apsl-2.0 70 apple apple public source licen[sc]e(?: (?:version |v )?2 0)?
ngpl 60 nethack nethack general public licen[sc]e
nasa-1.3 65 nasa nasa open source agreement(?: (?:version |v )?1 3)?
oclc-2.0 62 oclc oclc research public licen[sc]e(?: 2 0)?
jam 50 jam jam licen[sc]e
imagemagick 60 imagemagick imagemagick licen[sc]e
json 72 evil the software shall be used for good not evil
# creative commons and data
cc0-1.0 95 cc0 spdx license identifier cc0 1 0
cc0-1.0 80 cc0 cc0 1 0(?: universal)?
cc0 62 cc0 cc0(?: licen[sc]e)?
cc0 66 zero creative commons zero
cc0 74 creativecommons creativecommons org publicdomain zero 1 0
cc-pdm 72 creativecommons creativecommons org publicdomain mark 1 0
cc-by-4.0 90 cc spdx license identifier cc by 4 0
cc-by-sa-4.0 91 cc spdx license identifier cc by sa 4 0
cc-by-nc-4.0 91 cc spdx license identifier cc by nc 4 0
cc-by-nd-4.0 91 cc spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 92 cc spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 92 cc spdx license identifier cc by nc nd 4 0
cc-by-4.0 70 cc cc by 4 0
cc-by-3.0 70 cc cc by 3 0
cc-by-2.5 70 cc cc by 2 5
cc-by-2.0 70 cc cc by 2 0
cc-by-sa-4.0 74 cc cc by sa 4 0
cc-by-sa-3.0 74 cc cc by sa 3 0
cc-by-sa-2.5 74 cc cc by sa 2 5
cc-by-sa-2.0 74 cc cc by sa 2 0
cc-by-sa 66 cc cc by sa
cc-by-nc-4.0 74 cc cc by nc 4 0
cc-by-nc-3.0 74 cc cc by nc 3 0
cc-by-nc 66 cc cc by nc
cc-by-nd-4.0 74 cc cc by nd 4 0
cc-by-nd-3.0 74 cc cc by nd 3 0
cc-by-nd 66 cc cc by nd
cc-by-nc-sa-4.0 78 cc cc by nc sa 4 0
cc-by-nc-sa-3.0 78 cc cc by nc sa 3 0
cc-by-nc-sa 70 cc cc by nc sa
cc-by-nc-nd-4.0 78 cc cc by nc nd 4 0
cc-by-nc-nd-3.0 78 cc cc by nc nd 3 0
cc-by-nc-nd 70 cc cc by nc nd
cc-by 55 cc cc by
cc-by-4.0 76 commons creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-3.0 76 commons creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-4.0 82 commons creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 82 commons creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa 72 commons creative commons attribution share ?alike
cc-by-nc-sa 80 commons creative commons attribution non ?commercial share ?alike(?: [234] [05])?
cc-by-nc-nd 80 commons creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [234] [05])?
cc-by-nc 74 commons creative commons attribution non ?commercial(?: [234] [05])?
cc-by-nd 74 commons creative commons attribution no ?deriv(?:ative)?s?(?: [234] [05])?
cc-by 62 commons creative commons attribution
cc-by 72 creativecommons creativecommons org licenses by [1-4] [05]
cc-by-sa 76 creativecommons creativecommons org licenses by sa [1-4] [05]
cc-by-nc 76 creativecommons creativecommons org licenses by nc [1-4] [05]
cc-by-nd 76 creativecommons creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa 80 creativecommons creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd 80 creativecommons creativecommons org licenses by nc nd [1-4] [05]
odbl-1.0 78 database open (?:data commons open )?database licen[sc]e(?: (?:version |v )?1 0)?
odbl 50 odbl (?:the )?odbl
odc-by 70 commons open data commons attribution licen[sc]e
pddl 70 pddl (?:odc )?(?:the )?pddl
pddl 72 public public domain dedication and licen[sc]e
cdla-permissive 72 community community data licen[sc]e agreement permissive
cdla-sharing 72 community community data licen[sc]e agreement sharing
ogl-3.0 72 licen open government licen[sc]e(?: (?:version |v )?3(?: 0)?)?
etalab-2.0 70 etalab (?:etalab open licen[sc]e|licence ouverte)(?: 2 0)?
# source available
commons-clause 70 commons commons clause(?: licen[sc]e)?
busl-1.1 78 business business source licen[sc]e(?: 1 1)?
busl-1.1 90 busl spdx license identifier busl 1 1
sspl-1.0 78 server server side public licen[sc]e(?: (?:version |v )?1)?
sspl 50 sspl (?:the )?sspl
elastic-2.0 72 elastic elastic licen[sc]e(?: 2 0)?
polyform 72 polyform polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e
confluent 68 confluent confluent community licen[sc]e
timescale 68 timescale timescale licen[sc]e
rail 72 rail (?:open |creativeml open |bigscience )?rail(?: m)? licen[sc]e
llama 72 llama llama [1-4](?: [0-9])? community licen[sc]e(?: agreement)?
gemma 68 gemma gemma terms of use
# public domain, reservations and notices
public-domain 55 public (?:in|into|to) the public domain
public-domain 60 dedicated (?:is |are |hereby )?dedicated to the public domain
public-domain 40 public public domain
no-copyright 55 copyright no (?:known )?copyright(?: restrictions)?
reserved 45 rights all rights reserved
reserved 42 rights some rights reserved
reserved 40 rechte alle rechte vorbehalten
reserved 40 droits tous droits r\xc3\xa9serv\xc3\xa9s
reserved 40 derechos todos los derechos reservados
reserved 40 diritti tutti i diritti riservati
reserved 40 direitos todos os direitos reservados
reserved 40 rechten alle rechten voorbehouden
copyright 30 copyright copyright(?: c)? (?:19|20)[0-9][0-9]
copyright 25 copyright copyright c
copyright 30 copyrighted copyrighted by
copyright 28 copyright \xc2\xa9 copyright
proprietary 55 confidential (?:proprietary and confidential|confidential and proprietary)
proprietary 60 unauthorized unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)
proprietary 50 reproduced (?:may|must|shall) not be (?:copied|reproduced)
proprietary 52 permission (?:without|except with) (?:the )?(?:prior )?(?:express )?written (?:permission|consent)
proprietary 48 internal for internal use only
proprietary 50 trade (?:contains|constitutes) trade secrets
eula 55 user end user licen[sc]e agreement
eula 50 eula (?:this |the )?eula
terms 40 terms subject to (?:the |our )?terms (?:of service|and conditions)
no-warranty 35 warranty without (?:any )?warranty(?: of any kind)?
no-warranty 36 warranties without warranties or conditions of any kind
no-warranty 30 provided (?:is )?provided as is
no-warranty 34 liable in no event shall .{0,80}? be liable
noncommercial 52 commercial (?:for )?non ?commercial (?:use|purposes) only
noncommercial 50 personal for personal use only
noncommercial 50 commercial (?:not for|no) commercial (?:use|purposes)
research 50 research for (?:academic|research|educational) (?:use|purposes) only
attribution 40 credit (?:please )?(?:give|with) (?:appropriate )?credit to
attribution 42 permission (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission
opt-out 45 scraping (?:no|not permitted for) (?:web )?scraping
opt-out 50 training (?:may|must) not be used (?:for|in) (?:the )?training (?:of )?(?:ai|machine learning|language models)
opt-out 50 mining text and data mining (?:is |are )?(?:not permitted|prohibited|reserved)
spdx 40 spdx spdx license identifier
dual 50 dual dual licensed(?: under)?
multi 45 option at your option any later version
"""
# License families as (label, names), which may be referred to in any of the forms below.
FAMILIES = (
    ("apache", "apache"),
    ("mit", "mit|expat"),
    ("bsd", "bsd"),
    ("gpl", "gpl|gnu gpl|gnu general public"),
    ("lgpl", "lgpl|gnu lgpl|lesser general public|library general public"),
    ("agpl", "agpl|gnu agpl|affero general public"),
    ("gfdl", "gfdl|gnu free documentation"),
    ("mpl", "mpl|mozilla public"),
    ("epl", "epl|eclipse public"),
    ("cddl", "cddl|common development and distribution"),
    ("cpl", "common public"),
    ("eupl", "eupl|european union public"),
    ("artistic", "artistic"),
    ("zlib", "zlib|zlib libpng"),
    ("isc", "isc"),
    ("bsl", "boost software"),
    ("wtfpl", "wtfpl"),
    ("unlicense", "unlicense"),
    ("psf", "psf|python software foundation"),
    ("ofl", "ofl|sil open font"),
    ("odbl", "odbl|open database"),
    ("cecill", "cecill"),
    ("ms-pl", "microsoft public"),
    ("ms-rl", "microsoft reciprocal"),
    ("afl", "academic free"),
    ("osl", "osl|open software"),
    ("lppl", "latex project public"),
    ("cc0", "cc0|creative commons zero"),
    ("cc-by-sa", "cc by sa|creative commons attribution sharealike|creative commons attribution share alike"),
    ("cc-by-nc", "cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial"),
    ("cc-by-nd", "cc by nd|creative commons attribution noderivatives|creative commons attribution noderivs"),
    ("cc-by", "cc by|creative commons attribution"),
    ("commons-clause", "commons clause"),
    ("busl", "busl|business source"),
    ("sspl", "sspl|server side public"),
)
#: How a family is referred to, {} standing for its name, and the priority of that; below most signatures.
FORMS = (
    ("licensed under the {}", 36),
    ("released under the {}", 36),
    ("distributed under the {}", 36),
    ("available under the {}", 36),
    ("subject to the terms of the {}", 37),
    ("under the terms of the {}", 37),
    ("spdx license identifier {}", 39),
    ("{} license", 35),
    ("{} licence", 35),
    ("{} public license", 35),
)
_GAP = r"[^0-9a-z\x80-\xff]+"
_ALONE = r"(?<![0-9a-z\x80-\xff])", r"(?![0-9a-z\x80-\xff])"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: str
    priority: int
    weight: float


def phrase_pattern(words: str) -> str:
    """The words standing consecutively, whatever separates them."""
    return _GAP.join(re.findall(r"[0-9a-z\x80-\xff]+", words)).join(_ALONE)


def build_rules() -> list[Rule]:
    """The signatures in their order, then every family in every form."""
    rules = []
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("#"):
            continue
        label, priority, key, expression = line.split(" ", 3)
        rules.append(Rule(label, key.encode(), f"(?:{expression.replace(' ', _GAP)})".join(_ALONE), int(priority), int(priority) / 110))
    for label, names in FAMILIES:
        for name in names.split("|"):
            key = max(re.findall(WORD, name.encode()), key=len)
            rules += [Rule(label, key, phrase_pattern(form.format(name)), priority, 0.6) for form, priority in FORMS]
    return rules


@lru_cache(1)
def _machine():
    import ahocorasick

    by_key: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
    for r in build_rules():
        by_key.setdefault(r.keyword, []).append((r, re.compile(r.pattern.encode("latin-1"))))
    keys = ahocorasick.Automaton()
    for k in by_key:
        keys.add_word(k.decode("latin-1"), k)
    keys.make_automaton()
    base = [(label, re.compile(phrase_pattern(p).encode("latin-1")), p.split()[0].encode()) for p, label in BASE]
    return keys, by_key, base, re.compile(WORD)


def suppress(found: list[tuple[int, int, int, object]]) -> list[tuple[int, int, int, object]]:
    """Detections (priority, start, end, what) that lie within no better one.

    Better: higher priority, then longer, then earlier; a detection equal in span to a better
    one goes as well. Kept spans are held sorted, so each test is a search.
    """
    kept: list[tuple[int, int, int, object]] = []
    reach: list[tuple[int, int]] = []
    from bisect import bisect_right, insort

    for f in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1])):
        i = bisect_right(reach, (f[1], 1 << 62))
        if i and reach[i - 1][1] >= f[2]:
            continue
        kept.append(f)
        # spans that an earlier-starting one reaches beyond are never needed
        if not (i and reach[i - 1][1] >= f[2]):
            while i < len(reach) and reach[i][1] <= f[2]:
                del reach[i]
            insort(reach, (f[1], f[2]))
    return kept


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
    """Counts, labels, score and spans (label, byte start, byte end) of one text."""
    keys, by_key, base, word = _machine()
    raw = (text or "").encode().lower()
    n_words = len(word.findall(raw))
    places, own = [], set()
    for label, pattern, first in base:
        if first in raw:
            for m in pattern.finditer(raw):
                places.append(m.start())
                own.add(label)
    as_text = raw.decode("latin-1")
    # short keywords must begin a word: others hold them too often
    hit = {k for end, k in keys.iter(as_text) if len(k) > 4 or end < len(k) or not word.match(raw, end - len(k), end - len(k) + 1)}
    found, weight = [], {}
    for k in hit:
        for rule, pattern in by_key[k]:
            for m in pattern.finditer(raw):
                found.append((rule.priority, m.start(), m.end(), rule.label))
                weight[rule.label] = max(rule.weight, weight.get(rule.label, 0))
    kept = suppress(found)
    labels = own | {f[3] for f in kept}
    score = 1.0
    for x in labels:
        score *= 1 - weight.get(x, 0.5)
    starts = []
    if places:
        places.sort()
        at = count = 0
        for p in places:  # words before each place, in one walk
            count += len(word.findall(raw, at, p))
            starts.append(count)
            at = p
    spans = sorted((f[3], f[1], f[2]) for f in kept)
    return n_words, len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(own)), ",".join(sorted(labels)), round(1 - score, 6), spans


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """License labels of every text: a map without a shuffle.

    A null text counts as empty: no words, no labels, score 0. Repeated rows are scanned
    alike; columns besides the two named are ignored; an empty table gives none.

    Returns the id column, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` and, with ``spans``, ``spans`` in bytes.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        n = 9 if spans else 8
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = [scan_text(t) for t in part.column(1).to_pylist()]
                cols = list(zip(*rows))[: n - 1]
                if spans:
                    cols[-1] = [[{"label": a, "start": b, "stop": c} for a, b, c in x] for x in cols[-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names[:n])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", spans array<struct<label:string,start:long,stop:long>>" * spans
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of all ``documents``."""
    from folioscope.llm.common import table

    return scan_licenses(table(spark, sf_dir, "documents"), spans=False)
