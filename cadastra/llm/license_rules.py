"""Signature rules of the license scan, by hand: label, priority out of 100, keywords, pattern.

Patterns are for text in lower case with single blanks. Keywords are strings that every match
holds, each of them (of those with / one; _ is a blank); a rule is tried where they are in the
text. A group ``at`` narrows the place that counts. The label ``!`` takes away: it says that a
license doesn't hold, and what lies inside its place is no detection.
"""

#: Parts that patterns share, by name: a frame before a name, what follows a denial, an SPDX line.
PARTS = {
    "{under}": r"(?:(?:released|licen[cs]ed|distributed|available|published|provided|offered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?)?",
    "{rest}": r"(?:(?! but )(?:[^.,;:!?]|[.](?=\d)|,(?= v))){0,90}",
    "{spdx}": r"spdx-license-identifier: ?\(?(?:[\w.+()-]{1,40} (?:or|and|with) ){0,6}\(?",
}

TABLE = r"""
! | 100 | not under | not under (?:the |a |an |any ){rest}
! | 100 | not | not (?:currently |yet )?(?:licensed|released|distributed|available|published|provided|offered|covered|governed|placed) (?:under|by) {rest}
! | 100 | longer | no longer (?:licensed|released|distributed|available|published|provided|offered|covered) (?:under|by) {rest}
! | 100 | never under | never (?:been )?(?:licensed|released|distributed|available|published|provided|offered) under {rest}
! | 100 | incompatible with | incompatible with {rest}
! | 100 | nicht unter | nicht (?:mehr )?unter (?:der|die|einer) {rest}
! | 100 | under | (?:isn't|aren't|wasn't|weren't) (?:licen[cs]ed|released|distributed|available|published) under {rest}
mit | 96 | spdx mit | {spdx}(?P<at>mit)(?![-\w])
mit | 95 | under mit | (?:released|licensed|licenced|distributed|available|published|provided|offered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:permissive )?(?:mit|expat)(?: licen[cs]e)?
mit | 93 | licen mit | licen[cs]ed? ?[:=] ?["'(]?(?:the )?mit
mit | 90 | by mit | (?:governed|covered) by (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 85 | subject mit | subject to (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 80 | mit licen | (?:is|are) (?:under )?(?:the )?mit[- ]licen[cs]ed?
mit | 60 | mit licen | mit[- ](?:style )?licen[cs]ed?
mit | 92 | mit opensource | opensource\.org/licenses?/mit
mit | 98 | permission hereby obtaining | permission is hereby granted, free of charge, to any person obtaining a copy
mit | 84 | permission shall copies | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies
mit | 82 | restriction sublicense | without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense
mit | 62 | expat licen | expat licen[cs]e
mit | 86 | lizenz mit | unter (?:der )?mit[- ]lizenz
mit | 86 | sous licence mit | sous (?:la )?licence mit
mit | 86 | licencia mit | bajo (?:la )?licencia mit
mit-0 | 97 | mit-0 | (?:spdx-license-identifier: )?mit-0
mit-0 | 88 | mit attribution | mit no attribution(?: licen[cs]e)?
x11 | 70 | x11 licen | (?:mit/)?x11 licen[cs]e
x11 | 90 | consortium advertising | the name of the x consortium shall not be used in advertising
apache-2 | 96 | spdx apache-2 | {spdx}(?P<at>apache-2\.0)(?![-\w])
apache-2 | 95 | under apache | (?:released|licensed|licenced|distributed|available|published|provided|offered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?apache(?: software)?(?: licen[cs]e)?,? ?(?:version |ver\.? |v\.? ?)?2(?:\.0)?(?: licen[cs]e)?
apache-2 | 93 | licen apache | licen[cs]ed? ?[:=] ?["'(]?(?:the )?apache(?: licen[cs]e)?(?:, version |[- ]v?)2(?:\.0)?
apache-2 | 75 | apache licen | apache(?: software)? licen[cs]e,? ?(?:version |ver\.? |v\.? ?)?2(?:\.0)?
apache-2 | 74 | apache licen | apache[- ]v?2(?:\.0)?[- ]licen[cs]ed?
apache-2 | 72 | apache-2 | apache-2\.0(?![-\w])
apache-2 | 68 | asl 2 | asl[- ]v?2(?:\.0)?
apache-2 | 94 | apache licenses | apache\.org/licenses/license-2\.0
apache-2 | 88 | except compliance | you may not use this (?:file|software|work|code) except in compliance with the licen[cs]e
apache-2 | 86 | applicable writing | unless required by applicable law or agreed to in writing, software
apache-2 | 86 | apache lizenz | unter (?:der )?apache[- ]lizenz,? ?(?:version )?2(?:\.0)?
apache-1.1 | 80 | apache 1.1 | apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.1
apache-1.1 | 96 | spdx apache-1.1 | {spdx}(?P<at>apache-1\.1)
apache-1.1 | 87 | apache endorse | the names "?apache"? and "?apache software foundation"? must not be used to endorse
apache-1 | 80 | apache 1.0 | apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.0
apache | 45 | apache licen | apache(?: software)? licen[cs]ed?
gpl-1 | 80 | general_public/gpl 1 | (?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?1(?:\.0)?(?![.\d])
gpl-2 | 80 | general_public/gpl 2 | (?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?2(?:\.0)?(?:-only| only)?(?![.\d])
gpl-3 | 80 | general_public/gpl 3 | (?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?3(?:\.0)?(?:-only| only)?(?![.\d])
gpl-1-or-later | 97 | general_public/gpl later 1 | {under}(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?1(?:\.0)?(?:-| )or[- ](?:any )?later
gpl-2-or-later | 97 | general_public/gpl later 2 | {under}(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?2(?:\.0)?,?(?:-| )or[- ](?:\(at your option\) )?(?:any )?(?:later|newer)
gpl-3-or-later | 97 | general_public/gpl later 3 | {under}(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |ver\.? |v\.? ?|-)?3(?:\.0)?,?(?:-| )or[- ](?:\(at your option\) )?(?:any )?(?:later|newer)
gpl-2-or-later | 96 | 2 gpl | gpl ?(?:v|-)?2(?:\.0)?\+
gpl-3-or-later | 96 | 3 gpl | gpl ?(?:v|-)?3(?:\.0)?\+
gpl-2-or-later | 94 | option later 2 | either version 2 of the licen[cs]e,? or \(at your option\) any later version
gpl-3-or-later | 94 | option later 3 | either version 3 of the licen[cs]e,? or \(at your option\) any later version
gpl-2 | 95 | general_public/gpl under 2 | (?:released|licensed|licenced|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?|-)?2(?:\.0)?(?:-only| only)?
gpl-3 | 95 | general_public/gpl under 3 | (?:released|licensed|licenced|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:-only| only)?
gpl-2 | 92 | terms version 2 | under the terms of version 2 of the gnu general public licen[cs]e
gpl-3 | 92 | terms version 3 | under the terms of version 3 of the gnu general public licen[cs]e
gpl-2 | 91 | gnu licenses gpl-2 | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3 | 91 | gnu licenses gpl-3 | gnu\.org/licenses/gpl-3\.0
gpl | 70 | general_public/gpl gnu | gnu (?:general public licen[cs]e|gpl)
gpl | 66 | gpl licen | gpl[- ]licen[cs]ed?
gpl | 78 | redistribute gnu | redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl | 55 | implied merchantability | without even the implied warranty of merchantability or fitness
gpl | 72 | general received | you should have received a copy of the gnu general public licen[cs]e
classpath-exception | 88 | classpath exception | (?:gnu )?classpath(?:-exception| exception)(?:-2\.0)?
gcc-exception | 88 | gcc exception | gcc[- ](?:runtime[- ]library[- ])?exception(?:-\d\.\d)?
lgpl-2 | 82 | general_public/lgpl 2 | (?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |ver\.? |v\.? ?|-)?2(?:\.0)?(?:-only| only)?(?![.\d])
lgpl-2.1 | 83 | general_public/lgpl 2.1 | (?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |ver\.? |v\.? ?|-)?2\.1(?:-only| only)?
lgpl-3 | 82 | general_public/lgpl 3 | (?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |ver\.? |v\.? ?|-)?3(?:\.0)?(?:-only| only)?(?![.\d])
lgpl-2-or-later | 97 | general_public/lgpl later 2 | {under}(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |v\.? ?|-)?2(?:\.0)?(?:-| )or[- ](?:any )?later
lgpl-2.1-or-later | 97 | general_public/lgpl later 2.1 | {under}(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |v\.? ?|-)?2\.1(?:-| )or[- ](?:any )?later
lgpl-3-or-later | 97 | general_public/lgpl later 3 | {under}(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:-| )or[- ](?:any )?later
lgpl-2.1-or-later | 94 | lesser option later 2.1 | lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1 of the licen[cs]e, or \(at your option\) any later version
lgpl-3-or-later | 94 | lesser option later 3 | lesser general public licen[cs]e as published by the free software foundation[;,] either version 3 of the licen[cs]e, or \(at your option\) any later version
lgpl-2.1 | 95 | general_public/lgpl under 2.1 | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?|-)?2\.1(?:-only| only)?
lgpl-3 | 95 | general_public/lgpl under 3 | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:-only| only)?
lgpl | 71 | general_public licen | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl | 67 | lgpl | lgpl(?:[- ]licen[cs]ed?)?
agpl-3 | 82 | affero/agpl 3 | (?:gnu )?(?:affero general public licen[cs]e|agpl),? ?(?:version |ver\.? |v\.? ?|-)?3(?:\.0)?(?:-only| only)?(?![.\d])
agpl-3-or-later | 97 | affero/agpl later 3 | {under}(?:gnu )?(?:affero general public licen[cs]e|agpl),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:-| )or[- ](?:any )?later
agpl-1 | 82 | affero 1 | affero general public licen[cs]e,? ?(?:version |v\.? ?)?1(?:\.0)?(?![.\d])
agpl | 71 | affero | (?:gnu )?affero general public licen[cs]e
gfdl-1.1 | 84 | 1.1 documentation | gnu free documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.1
gfdl-1.2 | 84 | 1.2 documentation | gnu free documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.2
gfdl-1.3 | 84 | 1.3 documentation | gnu free documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.3
gfdl | 72 | documentation licen | gnu free documentation licen[cs]e
gfdl | 80 | invariant cover | with no invariant sections, (?:with )?no front-cover texts
gfdl | 65 | gfdl | gfdl(?:-1\.\d)?
bsd-0 | 90 | 0bsd | (?:spdx-license-identifier: )?0bsd
bsd-0 | 75 | clause bsd | (?:0|zero)[- ]clause[- ]bsd(?: licen[cs]e)?
bsd-1 | 75 | bsd-1 | bsd-1-clause
bsd-2 | 78 | bsd-2 | (?:spdx-license-identifier: )?bsd-2-clause(?:-(?:views|patent|freebsd))?
bsd-2 | 76 | clause bsd | (?:2|two)[- ]clause[- ]bsd(?: licen[cs]e)?
bsd-2 | 74 | simplified bsd | simplified bsd(?: licen[cs]e)?
bsd-2 | 70 | freebsd licen | freebsd licen[cs]e
bsd-2 | 70 | redistribution binary | redistribution and use in source and binary forms(?:, with or without modification, are permitted)?
bsd-2 | 58 | redistributions retain | redistributions of source code must retain the (?:above )?copyright notice
bsd-2 | 57 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-3 | 78 | bsd-3 | (?:spdx-license-identifier: )?bsd-3-clause(?:-\w+)?
bsd-3 | 76 | clause bsd | (?:3|three)[- ]clause[- ]bsd(?: licen[cs]e)?
bsd-3 | 74 | bsd licen | (?:new|revised|modified) bsd licen[cs]e
bsd-3 | 95 | under bsd-3 | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?bsd-3(?:-clause)?(?: licen[cs]e)?
bsd-2 | 95 | under bsd-2 | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?bsd-2(?:-clause)?(?: licen[cs]e)?
bsd-3 | 97 | neither contributors | neither the name of [^.;]{1,120}? nor the names of (?:its|the|any) contributors
bsd-4 | 76 | clause bsd | (?:4|four)[- ]clause[- ]bsd(?: licen[cs]e)?
bsd-4 | 74 | original bsd | original bsd(?: licen[cs]e)?
bsd-4 | 78 | bsd-4 | bsd-4-clause(?:-\w+)?
bsd-4 | 97 | advertising mentioning | all advertising materials mentioning features or use of this software must display
bsd | 50 | bsd licen | bsd(?:[- ]style)?[- ]licen[cs]ed?
mpl-1.0 | 80 | mozilla 1.0 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.0
mpl-1.1 | 80 | mozilla 1.1 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.1
mpl-1.1 | 79 | mpl 1.1 | mpl[- ]v?1\.1(?:[- ]licen[cs]ed?)?
mpl-2 | 80 | mozilla 2 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?
mpl-2 | 79 | mpl 2 | mpl(?:[- ]v?|v)2(?:\.0)?(?:[- ]licen[cs]ed?)?
mpl-2 | 96 | source mozilla 2.0 | this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0
mpl-2 | 92 | mozilla mpl/2 | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | 55 | mozilla licen | mozilla public licen[cs]e
epl-1 | 80 | eclipse 1 | eclipse public licen[cs]e(?: -)?,? ?(?:version |v\.? ?)?1(?:\.0)?
epl-2 | 80 | eclipse 2 | eclipse public licen[cs]e(?: -)?,? ?(?:version |v\.? ?)?2(?:\.0)?
epl-1 | 79 | epl 1 | epl[- ]v?1\.0
epl-2 | 79 | epl 2 | epl[- ]v?2\.0
edl-1 | 79 | eclipse distribution | eclipse distribution licen[cs]e(?: -)?,? ?(?:version |v\.? ?)?1(?:\.0)?
epl | 55 | eclipse licen | eclipse public licen[cs]e
cddl-1 | 80 | development distribution | common development and distribution licen[cs]e(?: \(cddl\))?,? ?(?:version |v\.? ?)?1?(?:\.0)?
cddl-1.1 | 82 | cddl 1.1 | cddl[- ]v?1\.1
cddl-1 | 78 | cddl | cddl(?:[- ]v?1\.0)?
cpl-1 | 80 | common public | common public licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
cpal-1 | 80 | common attribution | common public attribution licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
ipl-1 | 80 | ibm public | ibm public licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
eupl-1.1 | 82 | european union 1.1 | european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.1
eupl-1.2 | 82 | european union 1.2 | european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.2
eupl-1.2 | 80 | eupl 1.2 | eupl[- ]v?\.? ?1\.2
eupl | 60 | eupl | eupl
osl-3 | 80 | open software 3 | open software licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?
osl-3 | 78 | osl 3 | osl[- ]v?3\.0
afl-3 | 80 | academic 3 | academic free licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?
artistic-1 | 79 | artistic 1 | artistic licen[cs]e,? ?(?:version |v\.? ?)?1(?:\.0)?
artistic-2 | 80 | artistic 2 | artistic licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?
artistic-2 | 79 | artistic-2 | artistic-2\.0
artistic | 60 | artistic licen | artistic licen[cs]e
perl | 84 | perl itself | under the same terms as perl itself
boost-1 | 80 | boost licen | boost software licen[cs]e(?: -)?,? ?(?:version |v\.? ?)?1(?:\.0)?
boost-1 | 79 | bsl-1.0 | bsl-1\.0
boost-1 | 96 | derivative machine-executable | (?:solely in the form of )?machine-executable object code generated by a source language processor
zlib | 78 | zlib licen | zlib(?:/libpng)? licen[cs]ed?
zlib | 90 | as-is express implied | this software is provided ['"]as-is['"], without any express or implied warranty
zlib | 88 | origin misrepresented | the origin of this software must not be misrepresented
zlib | 96 | spdx zlib | {spdx}(?P<at>zlib)(?![-\w])
libpng | 80 | libpng licen | libpng licen[cs]e(?:,? version \d)?
isc | 78 | isc licen | isc licen[cs]ed?
isc | 97 | permission copies | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose
isc | 96 | spdx isc | {spdx}(?P<at>isc)(?![-\w])
isc | 93 | under isc | (?:released|licensed|licenced|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
unlicense | 80 | unlicense | (?:the )?unlicense
unlicense | 97 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 85 | what want public | do what the fuck you want to public licen[cs]e
wtfpl | 78 | wtfpl | wtfpl
beerware | 84 | beer | beer-?ware licen[cs]e
ofl-1.0 | 82 | font licen 1.0 | (?:sil )?open font licen[cs]e,? ?(?:version |v\.? ?)?1\.0
ofl-1.1 | 82 | font licen 1.1 | (?:sil )?open font licen[cs]e,? ?(?:version |v\.? ?)?1\.1
ofl-1.1 | 80 | ofl-1.1 | ofl-1\.1
ofl | 60 | open font | open font licen[cs]e
python-2 | 84 | python foundation | (?:python software foundation|psf) licen[cs]e(?: agreement)?,? ?(?:version |v\.? ?)?2?
python-2 | 80 | psf-2 | (?:psf|python)-2\.0
postgresql | 80 | postgresql licen | postgresql licen[cs]ed?
ms-pl | 82 | microsoft public | microsoft public licen[cs]e
ms-pl | 78 | ms-pl | ms-pl
ms-rl | 82 | microsoft reciprocal | microsoft reciprocal licen[cs]e
upl-1 | 82 | universal permissive | universal permissive licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
bsl-1.1 | 84 | business source | business source licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.1)?
bsl-1.1 | 80 | busl-1.1 | busl-1\.1
sspl-1 | 84 | server side | server side public licen[cs]e,? ?(?:version |v\.? ?)?1?
sspl-1 | 80 | sspl-1 | sspl-1\.0
elastic-2 | 84 | elastic licen | elastic licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?
commons-clause | 84 | commons clause | commons clause(?: licen[cs]e)? condition
polyform | 84 | polyform | polyform (?:noncommercial|small business|perimeter|shield|strict|free trial) licen[cs]e(?: \d\.\d\.\d)?
odbl-1 | 84 | database licen | open (?:data commons )?(?:open )?database licen[cs]e,? ?(?:\(odbl\) ?)?(?:version |v\.? ?)?1?(?:\.0)?
odbl-1 | 78 | odbl | odbl(?:-1\.0)?
odc-by-1 | 84 | commons attribution | open data commons attribution licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
pddl-1 | 84 | commons dedication | open data commons public domain dedication(?: and licen[cs]e)?
cc0-1 | 86 | cc0 | cc0(?:[- ]1\.0)?(?: universal)?
cc0-1 | 88 | commons zero | creative commons zero(?: v?1\.0)?(?: universal)?
cc0-1 | 92 | creativecommons zero | creativecommons\.org/publicdomain/zero
cc-pdm | 90 | creativecommons mark | creativecommons\.org/publicdomain/mark
cc-by-nc-nd | 94 | attribution commercial deriv | (?:creative commons|cc) attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?:[- ]\d(?:\.\d)?)?
cc-by-nc-sa | 94 | attribution commercial share | (?:creative commons|cc) attribution[- ]non-?commercial[- ]share-?alike(?:[- ]\d(?:\.\d)?)?
cc-by-nc | 92 | attribution commercial | (?:creative commons|cc) attribution[- ]non-?commercial(?:[- ]\d(?:\.\d)?)?
cc-by-nd | 92 | attribution deriv | (?:creative commons|cc) attribution[- ]no-?deriv(?:ative)?s?(?:[- ]\d(?:\.\d)?)?
cc-by-sa | 92 | attribution share | (?:creative commons|cc) attribution[- ]share-?alike(?:[- ]\d(?:\.\d)?)?
cc-by | 90 | attribution c | (?:creative commons|cc) attribution(?:[- ]\d(?:\.\d)?)?
cc-by-nc-nd | 93 | nc nd cc | cc[- ]by[- ]nc[- ]nd(?:[- ]\d\.\d)?
cc-by-nc-sa | 93 | nc sa cc | cc[- ]by[- ]nc[- ]sa(?:[- ]\d\.\d)?
cc-by-nc | 91 | nc cc | cc[- ]by[- ]nc(?:[- ]\d\.\d)?
cc-by-nd | 91 | nd cc | cc[- ]by[- ]nd(?:[- ]\d\.\d)?
cc-by-sa | 91 | sa cc | cc[- ]by[- ]sa(?:[- ]\d\.\d)?
cc-by | 89 | cc by | cc[- ]by(?:[- ]\d\.\d)?
cc-by-nc-nd | 95 | creativecommons by-nc-nd | creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa | 95 | creativecommons by-nc-sa | creativecommons\.org/licenses/by-nc-sa
cc-by-nc | 95 | creativecommons by-nc/ | creativecommons\.org/licenses/by-nc/
cc-by-nd | 95 | creativecommons by-nd | creativecommons\.org/licenses/by-nd
cc-by-sa | 95 | creativecommons by-sa | creativecommons\.org/licenses/by-sa
cc-by | 95 | creativecommons by/ | creativecommons\.org/licenses/by/
cc | 50 | creative commons | creative commons licen[cs]ed?
json | 90 | good evil | the software shall be used for good, not evil
vim | 80 | vim licen | vim licen[cs]e
ncsa | 82 | ncsa | (?:university of illinois/)?ncsa open source licen[cs]e
w3c | 82 | w3c | w3c (?:software|document)(?: notice and)? licen[cs]e
ruby | 78 | ruby licen | ruby(?:'s)? licen[cs]e
php-3 | 82 | php licen | php licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.01?)?
zpl-2 | 82 | zope public | zope public licen[cs]e,? ?(?:\(zpl\) ?)?(?:version |v\.? ?)?2?(?:\.\d)?
sleepycat | 80 | sleepycat | sleepycat licen[cs]e
openssl | 82 | openssl licen | openssl licen[cs]e
openssl | 90 | openssl includes | this product includes software developed by the openssl project
curl | 78 | curl licen | curl licen[cs]e
unicode | 82 | unicode licen | unicode(?:,? inc\.)? licen[cs]e(?: agreement)?
icu | 80 | icu licen | icu licen[cs]e
hpnd | 82 | historical notice | historical permission notice and disclaimer
ftl | 82 | freetype licen | freetype (?:project )?licen[cs]e
ijg | 84 | independent jpeg | (?:based in part on )?the work of the independent jpeg group
tcl | 78 | tcl licen | tcl(?:/tk)? licen[cs]e
lppl-1.3c | 82 | latex project | latex project public licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.3[ac]?)?
mulan-2 | 84 | mulan | mulan (?:psl|permissive software licen[cs]e),? ?(?:version |v\.? ?)?2?
npl-1.1 | 80 | netscape public | netscape public licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.1)?
sissl | 80 | sun standards | sun industry standards source licen[cs]e
qpl-1 | 80 | q public | q public licen[cs]e,? ?(?:version |v\.? ?)?1?(?:\.0)?
eiffel-2 | 80 | eiffel forum | eiffel forum licen[cs]e,? ?(?:version |v\.? ?)?2?
ecl-2 | 80 | educational community | educational community licen[cs]e,? ?(?:version |v\.? ?)?2?(?:\.0)?
openrail | 82 | rail | (?:creativeml |bigscience )?open[- ]?rail(?:[- ]?(?:m|\+\+-m))?(?: licen[cs]e)?
llama | 82 | llama licen | llama ?\d?(?:\.\d)? community licen[cs]e(?: agreement)?
ogl-3 | 84 | government | open government licen[cs]e,? ?(?:version |v\.? ?)?\d(?:\.0)?
ogl | 66 | government | open government licen[cs]e
etalab-2 | 82 | ouverte | licence ouverte(?: / open licence)?,? ?(?:version |v\.? ?)?2?(?:\.0)?
crown | 66 | crown copyright | crown copyright
public-domain | 85 | public domain | (?:released|dedicated|placed|put) (?:in)?to the public domain
public-domain | 84 | public domain | (?:placed|is|are|been|work|works) in the public domain
public-domain | 82 | gemeinfrei | (?:ist|sind) gemeinfrei
public-domain | 82 | domaine public | dans le domaine public
public-domain | 82 | dominio | (?:en|de) (?:el )?dominio p(?:ú|u)blico
all-rights-reserved | 50 | rights reserved | all rights reserved
all-rights-reserved | 50 | rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | 50 | tous droits | tous droits r(?:é|e)serv(?:é|e)s
all-rights-reserved | 50 | derechos reservados | todos los derechos reservados
proprietary | 57 | proprietary | proprietary (?:and confidential|software|licen[cs]e|information)
proprietary | 55 | may not | may not be (?:copied|reproduced|distributed|sold|republished|redistributed)
proprietary | 56 | written permission | without (?:the )?(?:prior |express |prior express )?written (?:permission|consent) of
proprietary | 56 | unauthorized | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|work|material|content)
proprietary | 56 | evaluation only | for evaluation (?:purposes )?only
non-commercial | 62 | commercial | for (?:personal,? )?(?:and )?non-?commercial (?:use|purposes) only
non-commercial | 62 | commercial | (?:no|not for) commercial use
commercial | 62 | commercial licen | (?:requires?|under) an? commercial licen[cs]e
copyright | 30 | copyright | copyright ?(?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)?\d\d)*
copyright | 30 | (c) | \(c\) ?(?:copyright )?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)?\d\d)*
copyright | 30 | © | © ?(?:copyright )?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)?\d\d)*
"""
