"""Signatures of license texts, headers, expressions, addresses and short names.

Each line of SIGNATURES is a rule: label, priority (1 is best), confidence, keywords of
which a text must hold one (single words in lower case, parted by ","), pattern (case does not count),
and a text that the rule finds; " ~ " parts them."""

from __future__ import annotations

# Signatures, grouped by license family.
SIGNATURES = r"""
mit ~ 1 ~ 0.95 ~ hereby ~ permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software\s+and\s+associated ~ Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit ~ 2 ~ 0.8 ~ copyright ~ the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies ~ The above copyright notice and this permission notice shall be included in all copies
mit ~ 2 ~ 0.8 ~ sublicense ~ use,\s+copy,\s+modify,\s+merge,\s+publish,\s+distribute,\s+sublicense,\s+and/or\s+sell ~ to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
mit ~ 2 ~ 0.7 ~ warrant ~ the\s+software\s+is\s+provided\s+.?as\s+is.?,\s+without\s+warranty\s+of\s+any\s+kind,\s+express\s+or\s+implied ~ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED
mit ~ 2 ~ 0.7 ~ liab ~ in\s+no\s+event\s+shall\s+the\s+authors\s+or\s+copyright\s+holders\s+be\s+liable\s+for\s+any\s+claim ~ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM
mit ~ 1 ~ 0.95 ~ opensource ~ opensource\.org/licenses?/mit(?![\w-]) ~ https://opensource.org/licenses/MIT
mit-0 ~ 1 ~ 0.95 ~ mit ~ mit-0(?![\w.-]*\w) ~ License: MIT-0
mit-feh ~ 2 ~ 0.8 ~ acknowledgment ~ acknowledgment\s+shall\s+be\s+given\s+in\s+the\s+documentation,?\s+materials\s+and\s+software\s+packages ~ acknowledgment shall be given in the documentation, materials and software packages
x11 ~ 2 ~ 0.8 ~ consortium ~ the\s+name\s+of\s+the\s+x\s+consortium\s+shall\s+not\s+be\s+used\s+in\s+advertising ~ Except as contained in this notice, the name of the X Consortium shall not be used in advertising
x11 ~ 3 ~ 0.6 ~ advertising ~ except\s+as\s+contained\s+in\s+this\s+notice,\s+the\s+names?\s+of\s+[\s\S]{1,100}?shall\s+not\s+be\s+used\s+in\s+advertising ~ Except as contained in this notice, the name of the author shall not be used in advertising
apache-2.0 ~ 1 ~ 1.0 ~ apache ~ (?:www\.)?apache\.org/licenses/license-2\.0 ~ http://www.apache.org/licenses/LICENSE-2.0
apache-1.1 ~ 1 ~ 1.0 ~ apache ~ (?:www\.)?apache\.org/licenses/license-1\.1 ~ http://www.apache.org/licenses/LICENSE-1.1
apache-2.0 ~ 1 ~ 0.95 ~ apache ~ apache\s+licen[cs]e\s*\n?\s*version\s+2\.0,\s+january\s+2004 ~ Apache License
 Version 2.0, January 2004
apache-2.0 ~ 1 ~ 0.95 ~ apache ~ licensed\s+under\s+the\s+apache\s+licen[cs]e,\s+version\s+2\.0\s+\(the\s+.license.\) ~ Licensed under the Apache License, Version 2.0 (the "License")
apache-2.0 ~ 2 ~ 0.8 ~ compliance ~ you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license ~ you may not use this file except in compliance with the License
apache-2.0 ~ 3 ~ 0.6 ~ warranties ~ without\s+warranties\s+or\s+conditions\s+of\s+any\s+kind,\s+either\s+express\s+or\s+implied ~ WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied
apache-2.0 ~ 2 ~ 0.85 ~ apache,asl,apl ~ (?<![\w.-])(?:apache[- ]?2(?:\.0)?|asl[- ]?2\.0|apl[- ]?2\.0)(?![\w.]*\w) ~ License: Apache-2.0
apache-1.1 ~ 2 ~ 0.8 ~ foundation ~ this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation ~ This product includes software developed by the Apache Software Foundation
apache-1.0 ~ 2 ~ 0.8 ~ apache ~ this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+group ~ This product includes software developed by the Apache Group
gpl-3 ~ 1 ~ 0.95 ~ version ~ gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,\s+(?:either\s+)?version\s+3 ~ GNU General Public License as published by the Free Software Foundation, either version 3 of the License
gpl-2 ~ 1 ~ 0.95 ~ version ~ gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+(?:either\s+)?version\s+2(?!\.) ~ GNU General Public License as published by the Free Software Foundation; either version 2 of the License
lgpl-2.1 ~ 1 ~ 0.95 ~ version ~ gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+(?:either\s+)?version\s+2\.1 ~ GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License
lgpl-3 ~ 1 ~ 0.95 ~ version ~ gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,\s+(?:either\s+)?version\s+3 ~ GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License
agpl-3 ~ 1 ~ 0.95 ~ version ~ gnu\s+affero\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,\s+(?:either\s+)?version\s+3 ~ GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License
gpl-3 ~ 1 ~ 0.95 ~ june ~ gnu\s+general\s+public\s+licen[cs]e\s+version\s+3,\s+29\s+june\s+2007 ~ GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
gpl-2 ~ 1 ~ 0.95 ~ june ~ gnu\s+general\s+public\s+licen[cs]e\s+version\s+2,\s+june\s+1991 ~ GNU GENERAL PUBLIC LICENSE Version 2, June 1991
gpl-1 ~ 1 ~ 0.95 ~ february ~ gnu\s+general\s+public\s+licen[cs]e\s+version\s+1,\s+february\s+1989 ~ GNU GENERAL PUBLIC LICENSE Version 1, February 1989
lgpl-2.1 ~ 1 ~ 0.95 ~ february ~ gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+version\s+2\.1,\s+february\s+1999 ~ GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
agpl-3 ~ 1 ~ 0.95 ~ november ~ gnu\s+affero\s+general\s+public\s+licen[cs]e\s+version\s+3,\s+19\s+november\s+2007 ~ GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
gpl-3 ~ 2 ~ 0.85 ~ gpl ~ (?<![\w.-])(?:gnu\s+)?gpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ released as GPLv3
gpl-2 ~ 2 ~ 0.85 ~ gpl ~ (?<![\w.-])(?:gnu\s+)?gpl[- ]?v?2(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ GPL-2.0-only OR MIT
gpl-1 ~ 2 ~ 0.85 ~ gpl ~ (?<![\w.-])(?:gnu\s+)?gpl[- ]?v?1(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ GPL-1.0-or-later
lgpl-3 ~ 2 ~ 0.85 ~ lgpl ~ (?<![\w.-])(?:gnu\s+)?lgpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ under LGPLv3
lgpl-2.1 ~ 2 ~ 0.85 ~ lgpl ~ (?<![\w.-])(?:gnu\s+)?lgpl[- ]?v?2\.1(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ LGPL-2.1+
lgpl-2 ~ 2 ~ 0.85 ~ lgpl ~ (?<![\w.-])(?:gnu\s+)?lgpl[- ]?v?2(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ LGPLv2+
agpl-3 ~ 2 ~ 0.85 ~ agpl ~ (?<![\w.-])(?:gnu\s+)?agpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-]*\w) ~ AGPL-3.0-or-later
gfdl-1.3 ~ 2 ~ 0.85 ~ gfdl ~ (?<![\w.-])gfdl[- ]?v?1\.3(?:-only|-or-later)?(?![\w.-]*\w) ~ GFDL-1.3
gpl ~ 1 ~ 0.9 ~ gnu ~ gnu\.org/(?:copyleft|licenses)/gpl(?:\.html|\.txt)? ~ https://www.gnu.org/licenses/gpl.html
lgpl ~ 1 ~ 0.9 ~ gnu ~ gnu\.org/(?:copyleft|licenses)/lgpl(?:\.html|\.txt)? ~ https://www.gnu.org/licenses/lgpl.html
agpl ~ 1 ~ 0.9 ~ gnu ~ gnu\.org/licenses/agpl(?:\.html|\.txt)? ~ https://www.gnu.org/licenses/agpl.html
gfdl ~ 1 ~ 0.9 ~ gnu ~ gnu\.org/(?:copyleft|licenses)/fdl(?:\.html|\.txt)? ~ https://www.gnu.org/licenses/fdl.html
gpl ~ 3 ~ 0.6 ~ particular ~ without\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability\s+or\s+fitness\s+for\s+a\s+particular\s+purpose\.\s+see\s+the\s+gnu\s+general ~ without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
gpl ~ 3 ~ 0.6 ~ software ~ free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms ~ This program is free software: you can redistribute it and/or modify it under the terms
gpl-classpath-exception ~ 1 ~ 0.9 ~ classpath,statically ~ classpath[- ]exception(?:-2\.0)?|linking\s+this\s+library\s+statically\s+or\s+dynamically\s+with\s+other\s+modules ~ GPL-2.0 WITH Classpath-exception-2.0
gpl-gcc-exception ~ 1 ~ 0.9 ~ gcc ~ gcc\s+runtime\s+library\s+exception|gcc-exception-\d ~ GCC Runtime Library Exception
gpl-bison-exception ~ 1 ~ 0.9 ~ bison ~ as\s+a\s+special\s+exception,\s+you\s+may\s+create\s+a\s+larger\s+work\s+that\s+contains\s+part\s+or\s+all\s+of\s+the\s+bison ~ As a special exception, you may create a larger work that contains part or all of the Bison parser skeleton
llvm-exception ~ 1 ~ 0.9 ~ llvm ~ (?:with\s+)?llvm[- ]exceptions? ~ Apache-2.0 WITH LLVM-exception
bsd-3-clause ~ 1 ~ 0.9 ~ endorse ~ neither\s+the\s+names?\s+of\s+[\s\S]{1,160}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products ~ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-3-clause ~ 1 ~ 0.85 ~ endorse ~ the\s+names?\s+of\s+the\s+author[s()]*\s+may\s+not\s+be\s+used\s+to\s+endorse\s+or\s+promote ~ The name of the author may not be used to endorse or promote products
bsd-4-clause ~ 1 ~ 0.9 ~ advertising ~ all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software\s+must\s+display ~ All advertising materials mentioning features or use of this software must display the following acknowledgement
bsd ~ 2 ~ 0.75 ~ redistributions ~ redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice ~ Redistributions of source code must retain the above copyright notice
bsd ~ 2 ~ 0.75 ~ redistributions ~ redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice ~ Redistributions in binary form must reproduce the above copyright notice
bsd ~ 3 ~ 0.65 ~ provided ~ this\s+software\s+is\s+provided\s+by\s+the\s+(?:copyright\s+holders|regents|author)\s[\s\S]{0,60}?as\s+is ~ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
bsd-3-clause ~ 1 ~ 0.95 ~ opensource ~ opensource\.org/licenses?/bsd-3-clause ~ https://opensource.org/licenses/BSD-3-Clause
bsd-2-clause ~ 1 ~ 0.95 ~ opensource ~ opensource\.org/licenses?/bsd-2-clause ~ https://opensource.org/licenses/BSD-2-Clause
bsd-3-clause-clear ~ 1 ~ 0.9 ~ patent ~ no\s+express\s+or\s+implied\s+licenses\s+to\s+any\s+party.s\s+patent\s+rights\s+are\s+granted\s+by\s+this\s+license ~ NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE
bsd-2-clause-patent ~ 1 ~ 0.9 ~ patent ~ bsd-?\s?2-clause[- ]plus[- ]patent|bsd\+patent|bsd-2-clause-patent ~ BSD-2-Clause-Patent
bsd-3-clause ~ 2 ~ 0.85 ~ bsd ~ (?<![\w.-])bsd[- ]3(?:[- ]clause)?(?![\w.-]*\w) ~ license = BSD-3-Clause
bsd-2-clause ~ 2 ~ 0.85 ~ bsd ~ (?<![\w.-])bsd[- ]2(?:[- ]clause)?(?![\w.-]*\w) ~ license = BSD-2-Clause
0bsd ~ 2 ~ 0.85 ~ 0bsd ~ (?<![\w.-])0bsd(?![\w.-]*\w) ~ license: 0BSD
isc ~ 1 ~ 0.95 ~ permission ~ permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee ~ Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
isc ~ 3 ~ 0.6 ~ disclaims ~ the\s+software\s+is\s+provided\s+.?as\s+is.?\s+and\s+the\s+author\s+disclaims\s+all\s+warranties ~ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
hpnd ~ 2 ~ 0.8 ~ documentation ~ appears?\s+in\s+all\s+copies\s+and\s+that\s+both\s+that\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+appear\s+in\s+supporting\s+documentation ~ appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
ntp ~ 2 ~ 0.8 ~ suitability ~ makes\s+no\s+representations\s+about\s+the\s+suitability\s+(?:of\s+)?this\s+software\s+for\s+any\s+purpose ~ makes no representations about the suitability this software for any purpose
zlib ~ 1 ~ 0.95 ~ warrant ~ this\s+software\s+is\s+provided\s+.?as-is.?,\s+without\s+any\s+express\s+or\s+implied\s+warranty ~ This software is provided 'as-is', without any express or implied warranty
zlib ~ 2 ~ 0.8 ~ misrepresented ~ the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented ~ The origin of this software must not be misrepresented
zlib ~ 2 ~ 0.8 ~ altered ~ altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such ~ Altered source versions must be plainly marked as such, and must not be misrepresented
zlib ~ 2 ~ 0.7 ~ altered ~ this\s+notice\s+may\s+not\s+be\s+removed\s+or\s+altered\s+from\s+any\s+source\s+distribution ~ This notice may not be removed or altered from any source distribution
bsl-1.0 ~ 1 ~ 0.95 ~ boost ~ boost\s+software\s+licen[cs]e\s+-\s+version\s+1\.0\s+-\s+august\s+17th,?\s+2003 ~ Boost Software License - Version 1.0 - August 17th, 2003
bsl-1.0 ~ 1 ~ 0.95 ~ hereby ~ permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy ~ Permission is hereby granted, free of charge, to any person or organization obtaining a copy
bsl-1.0 ~ 1 ~ 1.0 ~ boost ~ (?:www\.)?boost\.org/license_1_0\.txt ~ http://www.boost.org/LICENSE_1_0.txt
bsl-1.0 ~ 2 ~ 0.85 ~ bsl ~ (?<![\w.-])bsl-1\.0(?![\w.-]*\w) ~ license: BSL-1.0
mpl-2.0 ~ 1 ~ 0.95 ~ mozilla ~ subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e,\s+v\.\s*2\.0 ~ This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0
mpl-2.0 ~ 1 ~ 1.0 ~ mozilla ~ mozilla\.org/mpl/2\.0 ~ http://mozilla.org/MPL/2.0/
mpl-1.1 ~ 1 ~ 1.0 ~ mozilla ~ mozilla\.org/mpl/mpl-1\.1 ~ http://www.mozilla.org/MPL/MPL-1.1.html
mpl-1.1 ~ 1 ~ 0.95 ~ mozilla ~ mozilla\s+public\s+licen[cs]e\s+version\s+1\.1\s+\(the\s+.license.\) ~ subject to the Mozilla Public License Version 1.1 (the "License")
mpl-2.0 ~ 2 ~ 0.85 ~ mpl ~ (?<![\w.-])mpl[- ]?v?2(?:\.0)?(?![\w.-]*\w) ~ dual MPL-2.0
mpl-1.1 ~ 2 ~ 0.85 ~ mpl ~ (?<![\w.-])mpl[- ]1\.1(?![\w.-]*\w) ~ MPL 1.1
mpl-2.0-no-copyleft ~ 1 ~ 0.9 ~ secondary ~ incompatible\s+with\s+secondary\s+licenses ~ This Source Code Form is "Incompatible With Secondary Licenses"
epl-2.0 ~ 1 ~ 1.0 ~ eclipse ~ eclipse\.org/legal/epl-2\.0|eclipse\.org/legal/epl-v20 ~ https://www.eclipse.org/legal/epl-2.0/
epl-1.0 ~ 1 ~ 1.0 ~ eclipse ~ eclipse\.org/legal/epl-v10 ~ http://www.eclipse.org/legal/epl-v10.html
edl-1.0 ~ 1 ~ 0.95 ~ eclipse ~ eclipse\s+distribution\s+licen[cs]e(?:\s*-)?\s+v(?:ersion)?\s*1\.0|eclipse\.org/org/documents/edl-v10 ~ Eclipse Distribution License v1.0
epl-2.0 ~ 2 ~ 0.85 ~ epl ~ (?<![\w.-])epl[- ]?v?2\.0(?![\w.-]*\w) ~ EPL-2.0
epl-1.0 ~ 2 ~ 0.85 ~ epl ~ (?<![\w.-])epl[- ]?v?1\.0(?![\w.-]*\w) ~ EPL-1.0
cddl-1.0 ~ 2 ~ 0.85 ~ cddl ~ (?<![\w.-])cddl[- ]?(?:v|version\s)?1\.0(?![\w.-]*\w) ~ CDDL-1.0
cddl-1.1 ~ 2 ~ 0.85 ~ cddl ~ (?<![\w.-])cddl[- ]?(?:v|version\s)?1\.1(?![\w.-]*\w) ~ CDDL 1.1
cddl ~ 3 ~ 0.7 ~ cddl ~ (?<![\w.-])cddl(?![\w.-]*\w) ~ under the CDDL
eupl-1.2 ~ 2 ~ 0.85 ~ eupl ~ (?<![\w.-])eupl[- ,]*(?:v\.?\s?|version\s)?1\.2(?![\w.-]*\w) ~ EUPL v1.2
eupl-1.1 ~ 2 ~ 0.85 ~ eupl ~ (?<![\w.-])eupl[- ,]*(?:v\.?\s?|version\s)?1\.1(?![\w.-]*\w) ~ EUPL, Version 1.1
eupl ~ 3 ~ 0.7 ~ eupl ~ (?<![\w.-])eupl(?![\w.-]*\w) ~ the EUPL applies
cpl-1.0 ~ 2 ~ 0.85 ~ cpl ~ (?<![\w.-])cpl[- ]?v?1\.0(?![\w.-]*\w) ~ CPL-1.0
ipl-1.0 ~ 1 ~ 0.9 ~ ibm ~ ibm\s+public\s+licen[cs]e(?:\s+version)?\s+1\.0 ~ IBM Public License Version 1.0
apsl-2.0 ~ 1 ~ 0.9 ~ apple ~ apple\s+public\s+source\s+licen[cs]e(?:\s+version)?\s+2\.0 ~ Apple Public Source License Version 2.0
cpal-1.0 ~ 1 ~ 0.9 ~ attribution ~ common\s+public\s+attribution\s+licen[cs]e(?:\s+version)?\s+1\.0 ~ Common Public Attribution License Version 1.0
sissl ~ 1 ~ 0.9 ~ standards ~ sun\s+industry\s+standards\s+source\s+licen[cs]e ~ Sun Industry Standards Source License
spl-1.0 ~ 1 ~ 0.9 ~ public ~ sun\s+public\s+licen[cs]e(?:\s+version)?\s+1\.0 ~ Sun Public License Version 1.0
npl-1.1 ~ 1 ~ 0.9 ~ netscape ~ netscape\s+public\s+licen[cs]e(?:\s+version)?\s+1\.1 ~ Netscape Public License Version 1.1
nokia ~ 1 ~ 0.85 ~ nokia ~ nokia\s+open\s+source\s+licen[cs]e ~ Nokia Open Source License
rpl-1.5 ~ 1 ~ 0.9 ~ reciprocal ~ reciprocal\s+public\s+licen[cs]e(?:,?\s+version)?\s+1\.5 ~ Reciprocal Public License 1.5
sleepycat ~ 1 ~ 0.9 ~ sleepycat,redistributions ~ sleepycat\s+licen[cs]e|redistributions\s+in\s+any\s+form\s+must\s+be\s+accompanied\s+by\s+information\s+on\s+how\s+to\s+obtain\s+complete\s+source ~ the Sleepycat License
artistic-2.0 ~ 1 ~ 1.0 ~ perlfoundation,artistic ~ perlfoundation\.org/artistic_license_2_0|opensource\.org/licenses?/artistic-2\.0 ~ http://www.perlfoundation.org/artistic_license_2_0
artistic-1.0-perl ~ 1 ~ 0.9 ~ itself ~ (?:under\s+the\s+)?same\s+terms\s+as\s+perl\s+itself ~ under the same terms as Perl itself
clartistic ~ 1 ~ 0.9 ~ clarified ~ clarified\s+artistic\s+licen[cs]e ~ Clarified Artistic License
unlicense ~ 1 ~ 0.95 ~ unencumbered ~ this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain ~ This is free and unencumbered software released into the public domain
unlicense ~ 1 ~ 1.0 ~ unlicense ~ unlicense\.org ~ For more information, see http://unlicense.org/
wtfpl ~ 1 ~ 0.95 ~ just ~ you\s+just\s+do\s+what\s+the\s+\S+\s+you\s+want\s+to ~ 0. You just DO WHAT THE HECK YOU WANT TO
beerware ~ 1 ~ 0.9 ~ beer ~ beer-?ware\s+licen[cs]e|buy\s+me\s+a\s+beer\s+in\s+return ~ THE BEER-WARE LICENSE
json ~ 1 ~ 0.9 ~ good,evil ~ shall\s+be\s+used\s+for\s+good,\s+not\s+evil ~ The Software shall be used for Good, not Evil
cc0-1.0 ~ 1 ~ 1.0 ~ creativecommons ~ creativecommons\.org/publicdomain/zero/1\.0 ~ https://creativecommons.org/publicdomain/zero/1.0/
cc-pd ~ 1 ~ 0.95 ~ creativecommons ~ creativecommons\.org/publicdomain/mark/1\.0 ~ https://creativecommons.org/publicdomain/mark/1.0/
cc0-1.0 ~ 2 ~ 0.9 ~ cc0 ~ (?<![\w.-])cc0[- ]1\.0(?:\s+universal)?(?![\w.-]*\w) ~ CC0 1.0 Universal
public-domain ~ 3 ~ 0.6 ~ copyright ~ no\s+known\s+copyright\s+restrictions ~ There are no known copyright restrictions
public-domain ~ 3 ~ 0.6 ~ public ~ (?:is|are)\s+in\s+the\s+public\s+domain ~ This file is in the public domain
pddl-1.0 ~ 1 ~ 0.95 ~ opendatacommons ~ opendatacommons\.org/licenses/pddl ~ https://opendatacommons.org/licenses/pddl/1-0/
odbl-1.0 ~ 1 ~ 0.95 ~ opendatacommons,odbl ~ opendatacommons\.org/licenses/odbl|(?<![\w.-])odbl[- ]?1\.0(?![\w.-]*\w) ~ https://opendatacommons.org/licenses/odbl/
odc-by-1.0 ~ 1 ~ 0.95 ~ opendatacommons,odc ~ opendatacommons\.org/licenses/by|(?<![\w.-])odc-by(?:-1\.0)?(?![\w.-]*\w) ~ https://opendatacommons.org/licenses/by/1-0/
cdla-permissive-2.0 ~ 1 ~ 0.95 ~ community ~ community\s+data\s+licen[cs]e\s+agreement\s*[-–]?\s*permissive(?:,?\s*[-–]?\s*version\s+2\.0)? ~ Community Data License Agreement - Permissive - Version 2.0
cdla-sharing-1.0 ~ 1 ~ 0.95 ~ community ~ community\s+data\s+licen[cs]e\s+agreement\s*[-–]?\s*sharing ~ Community Data License Agreement - Sharing - Version 1.0
ofl-1.1 ~ 1 ~ 1.0 ~ scripts,openfontlicense ~ scripts\.sil\.org/ofl|openfontlicense\.org ~ http://scripts.sil.org/OFL
ofl-1.1 ~ 2 ~ 0.85 ~ reserved ~ with\s+reserved\s+font\s+names? ~ Copyright 2010 A Foundry, with Reserved Font Name "Demo"
ofl-1.1 ~ 2 ~ 0.85 ~ ofl ~ (?<![\w.-])ofl[- ]1\.1(?![\w.-]*\w) ~ OFL-1.1
ufl-1.0 ~ 1 ~ 0.9 ~ ubuntu ~ ubuntu\s+font\s+licen[cs]e(?:\s+version)?\s+1\.0 ~ Ubuntu Font Licence Version 1.0
osl-3.0 ~ 2 ~ 0.85 ~ osl ~ (?<![\w.-])osl[- ]?v?3\.0(?![\w.-]*\w) ~ OSL-3.0
afl-3.0 ~ 2 ~ 0.85 ~ afl ~ (?<![\w.-])afl[- ]?v?3\.0(?![\w.-]*\w) ~ AFL-3.0
ecl-2.0 ~ 2 ~ 0.85 ~ ecl ~ (?<![\w.-])ecl[- ]?v?2\.0(?![\w.-]*\w) ~ ECL-2.0
ncsa ~ 2 ~ 0.8 ~ illinois ~ university\s+of\s+illinois\s+at\s+urbana-champaign,?\s+nor\s+the\s+names\s+of\s+its\s+contributors ~ University of Illinois at Urbana-Champaign, nor the names of its contributors
python-2.0 ~ 1 ~ 0.9 ~ python,psf ~ python\s+software\s+foundation\s+licen[cs]e\s+version\s+2|psf-2\.0|psfl(?![\w.-]*\w) ~ PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2
php-3.01 ~ 1 ~ 1.0 ~ php ~ php\.net/license/3_01\.txt ~ http://www.php.net/license/3_01.txt
ruby ~ 2 ~ 0.8 ~ ruby ~ same\s+(?:terms|licen[cs]e)\s+as\s+ruby ~ under the same terms as Ruby
tcl ~ 2 ~ 0.8 ~ tcl ~ tcl/tk\s+licen[cs]e|tcl\s+licen[cs]e\s+terms ~ the Tcl/Tk license
curl ~ 2 ~ 0.8 ~ curl ~ curl\s+licen[cs]e|curl\.(?:se|haxx\.se)/docs/copyright ~ https://curl.se/docs/copyright.html
openssl ~ 1 ~ 0.9 ~ openssl ~ this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project ~ This product includes software developed by the OpenSSL Project
ssleay ~ 1 ~ 0.9 ~ young ~ this\s+product\s+includes\s+cryptographic\s+software\s+written\s+by\s+eric\s+young ~ This product includes cryptographic software written by Eric Young
icu ~ 2 ~ 0.8 ~ unicode,icu ~ unicode\s+licen[cs]e\s+v3|icu\s+licen[cs]e|unicode-dfs-201\d ~ Unicode License v3
ijg ~ 2 ~ 0.8 ~ independent ~ this\s+software\s+is\s+based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg\s+group ~ this software is based in part on the work of the Independent JPEG Group
libtiff ~ 2 ~ 0.8 ~ leffler ~ the\s+names\s+of\s+sam\s+leffler\s+and\s+silicon\s+graphics\s+may\s+not\s+be\s+used ~ the names of Sam Leffler and Silicon Graphics may not be used
freetype ~ 2 ~ 0.85 ~ freetype ~ freetype\s+(?:project\s+)?licen[cs]e|portions\s+of\s+this\s+software\s+are\s+copyright.{1,40}the\s+freetype\s+project ~ the FreeType Project LICENSE
imagemagick ~ 2 ~ 0.85 ~ imagemagick ~ imagemagick(?:\.org/script/license|\s+licen[cs]e) ~ https://imagemagick.org/script/license.php
cecill-2.1 ~ 1 ~ 1.0 ~ cecill ~ cecill\.info/licences/licence_cecill_v2\.1 ~ http://www.cecill.info/licences/Licence_CeCILL_V2.1-en.html
sspl-1 ~ 2 ~ 0.85 ~ sspl ~ (?<![\w.-])sspl[- ]?v?1(?:\.0)?(?![\w.-]*\w) ~ SSPL-1.0
busl-1.1 ~ 2 ~ 0.85 ~ busl ~ (?<![\w.-])busl[- ]?1\.1(?![\w.-]*\w) ~ BUSL-1.1
busl-1.1 ~ 2 ~ 0.8 ~ change,grant ~ additional\s+use\s+grant:|change\s+license:|change\s+date: ~ Change Date: 2028-01-01
elastic-2.0 ~ 2 ~ 0.85 ~ elastic ~ elastic\.co/licensing/elastic-license|(?<![\w.-])elastic-2\.0(?![\w.-]*\w) ~ https://www.elastic.co/licensing/elastic-license
commons-clause ~ 1 ~ 0.9 ~ commons,limiting ~ .?commons\s+clause.?\s+licen[cs]e\s+condition|without\s+limiting\s+other\s+conditions[\s\S]{1,100}?does\s+not\s+include.{1,60}right\s+to\s+sell ~ "Commons Clause" License Condition v1.0
polyform-noncommercial ~ 1 ~ 0.9 ~ polyform ~ polyform\s+noncommercial\s+licen[cs]e|polyform-noncommercial ~ PolyForm Noncommercial License 1.0.0
polyform-shield ~ 1 ~ 0.9 ~ polyform ~ polyform\s+shield\s+licen[cs]e|polyform-shield ~ PolyForm Shield License 1.0.0
fsl ~ 1 ~ 0.85 ~ functional ~ functional\s+source\s+licen[cs]e ~ Functional Source License, Version 1.1
prosperity ~ 1 ~ 0.85 ~ prosperity ~ prosperity\s+public\s+licen[cs]e ~ The Prosperity Public License 3.0.0
parity ~ 1 ~ 0.85 ~ parity ~ parity\s+public\s+licen[cs]e ~ The Parity Public License 7.0.0
blueoak-1.0.0 ~ 1 ~ 0.9 ~ blue,blueoak ~ blue\s+oak\s+model\s+licen[cs]e|blueoak-1\.0\.0 ~ Blue Oak Model License 1.0.0
openrail-m ~ 1 ~ 0.9 ~ rail ~ (?:creativeml|bigscience|bigcode)[-\s]+(?:open)?rail(?:[-+]*m)?(?:\s+licen[cs]e)? ~ CreativeML OpenRAIL-M
llama ~ 1 ~ 0.9 ~ llama ~ llama\s+(?:2|3(?:\.\d)?)\s+community\s+licen[cs]e ~ Llama 2 Community License Agreement
gemma ~ 2 ~ 0.8 ~ gemma ~ gemma\s+terms\s+of\s+use ~ the Gemma Terms of Use
hippocratic ~ 1 ~ 0.85 ~ hippocratic ~ hippocratic\s+licen[cs]e ~ Hippocratic License 3.0
oracle-bcl ~ 1 ~ 0.85 ~ oracle,microsystems ~ (?:oracle|sun\s+microsystems,?\s+inc\.?)\s+binary\s+code\s+licen[cs]e ~ Oracle Binary Code License Agreement
ms-eula ~ 2 ~ 0.8 ~ microsoft ~ microsoft\s+software\s+licen[cs]e\s+terms ~ MICROSOFT SOFTWARE LICENSE TERMS
eula ~ 3 ~ 0.6 ~ user ~ end[- ]user\s+licen[cs]e\s+agreement ~ This End-User License Agreement
aladdin ~ 1 ~ 0.85 ~ aladdin ~ aladdin\s+free\s+public\s+licen[cs]e ~ Aladdin Free Public License
ppl ~ 1 ~ 0.85 ~ production ~ peer\s+production\s+licen[cs]e ~ Peer Production License
free-art-1.3 ~ 1 ~ 0.85 ~ free ~ free\s+art\s+licen[cs]e(?:\s+1\.3)? ~ Free Art License 1.3
dl-de-by-2.0 ~ 1 ~ 0.95 ~ govdata,dl-de ~ govdata\.de/dl-de/by-2-0|dl-de[-/]by-2[.-]0 ~ https://www.govdata.de/dl-de/by-2-0
ogl-uk-3.0 ~ 1 ~ 1.0 ~ nationalarchives ~ nationalarchives\.gov\.uk/doc/open-government-licence/version/3 ~ http://www.nationalarchives.gov.uk/doc/open-government-licence/version/3/
etalab-2.0 ~ 1 ~ 0.9 ~ etalab,ouverte ~ etalab[- ]2\.0|licence\s+ouverte ~ Licence Ouverte
us-gov-work ~ 2 ~ 0.7 ~ government ~ (?:is\s+a\s+)?work\s+of\s+the\s+(?:united\s+states|u\.s\.)\s+government ~ This is a work of the United States Government
non-commercial ~ 3 ~ 0.5 ~ commercial ~ for\s+(?:personal|research|academic|educational)(?:,?\s+(?:and|or)?\s*(?:personal|research|academic|educational))*\s+(?:and\s+|or\s+)?non-?commercial\s+(?:use|purposes) ~ for research and non-commercial use only
proprietary ~ 3 ~ 0.6 ~ unauthori ~ unauthori[sz]ed\s+(?:copying|reproduction|distribution|use)\s+of\s+this\s+(?:file|software|document) ~ Unauthorized copying of this file is prohibited
proprietary ~ 3 ~ 0.6 ~ secret ~ (?:contains|constitutes?)\s+(?:the\s+)?(?:confidential|proprietary)\s+(?:information|and)\s[\s\S]{0,60}?trade\s+secrets? ~ contains confidential and proprietary trade secrets
no-license ~ 3 ~ 0.5 ~ licen ~ no\s+licen[cs]e\s+(?:is\s+)?(?:granted|expressed|implied) ~ No license is granted
dual-license ~ 3 ~ 0.5 ~ dual ~ dual[- ]licen[cs]ed ~ This crate is dual-licensed
mit ~ 2 ~ 0.85 ~ mit ~ (?<![\w.-])mit\s+(?:or|and)\s+[a-z]+-?\d|[a-z0-9.]+(?:-only|-or-later)?\s+(?:or|and)\s+mit(?![\w.-]*\w) ~ Apache-2.0 OR MIT
gpl ~ 3 ~ 0.6 ~ verbatim ~ everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+license\s+document ~ Everyone is permitted to copy and distribute verbatim copies of this license document
gpl ~ 3 ~ 0.65 ~ received ~ you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e ~ You should have received a copy of the GNU General Public License
lgpl ~ 2 ~ 0.75 ~ received ~ you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e ~ You should have received a copy of the GNU Lesser General Public License
agpl ~ 2 ~ 0.75 ~ received ~ you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+licen[cs]e ~ You should have received a copy of the GNU Affero General Public License
lgpl-2 ~ 1 ~ 0.95 ~ library ~ gnu\s+library\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+(?:either\s+)?version\s+2(?!\.) ~ GNU Library General Public License as published by the Free Software Foundation; either version 2
gpl-2 ~ 1 ~ 0.9 ~ version ~ version\s+2\s+of\s+the\s+(?:gnu\s+general\s+public\s+)?licen[cs]e,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version ~ either version 2 of the License, or (at your option) any later version
gpl-3 ~ 1 ~ 0.9 ~ version ~ version\s+3\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e ~ under the terms of version 3 of the GNU General Public License
lgpl-3 ~ 1 ~ 0.9 ~ version ~ version\s+3\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+licen[cs]e ~ under version 3 of the GNU Lesser General Public License
lgpl-2.1 ~ 1 ~ 0.9 ~ version ~ version\s+2\.1\s+of\s+the\s+(?:gnu\s+lesser\s+general\s+public\s+)?licen[cs]e ~ either version 2.1 of the License, or (at your option) any later version
agpl-3 ~ 1 ~ 0.9 ~ version ~ version\s+3\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+licen[cs]e ~ under version 3 of the GNU Affero General Public License
gfdl ~ 2 ~ 0.85 ~ documentation ~ permission\s+is\s+granted\s+to\s+copy,\s+distribute\s+and/or\s+modify\s+this\s+document\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+free\s+documentation\s+licen[cs]e ~ Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License
apache-2.0 ~ 2 ~ 0.8 ~ governing ~ see\s+the\s+license\s+for\s+the\s+specific\s+language\s+governing\s+permissions\s+and\s+limitations ~ See the License for the specific language governing permissions and limitations under the License
apache-2.0 ~ 2 ~ 0.8 ~ applicable ~ unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,\s+software\s+distributed\s+under\s+the\s+license ~ Unless required by applicable law or agreed to in writing, software distributed under the License
bsd ~ 3 ~ 0.7 ~ redistributions ~ redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+(?:above\s+)?copyright\s+notice ~ Redistributions of source code must retain the above copyright notice
bsd ~ 3 ~ 0.7 ~ redistributions ~ redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+(?:above\s+)?copyright\s+notice ~ Redistributions in binary form must reproduce the above copyright notice
epl-2.0 ~ 1 ~ 0.95 ~ eclipse ~ made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+v?\.?\s*2\.0 ~ This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
epl-1.0 ~ 1 ~ 0.95 ~ eclipse ~ made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+v?\.?\s*1\.0 ~ made available under the terms of the Eclipse Public License v1.0
cddl ~ 2 ~ 0.85 ~ contents ~ contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+licen[cs]e ~ The contents of this file are subject to the terms of the Common Development and Distribution License
apsl-2.0 ~ 1 ~ 0.95 ~ apple ~ subject\s+to\s+the\s+apple\s+public\s+source\s+licen[cs]e\s+version\s+2\.0 ~ that are subject to the Apple Public Source License Version 2.0
isc ~ 1 ~ 0.95 ~ hereby ~ permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted ~ Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
postgresql ~ 1 ~ 0.95 ~ agreement ~ for\s+any\s+purpose,\s+without\s+fee,\s+and\s+without\s+a\s+written\s+agreement\s+is\s+hereby\s+granted ~ for any purpose, without fee, and without a written agreement is hereby granted
w3c ~ 2 ~ 0.8 ~ licensee ~ by\s+(?:obtaining|using)[,\s]+(?:using\s+)?and/or\s+copying\s+this\s+work,\s+you\s+\(the\s+licensee\)\s+agree ~ By obtaining, using and/or copying this work, you (the licensee) agree
unicode ~ 1 ~ 0.9 ~ hereby ~ hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+(?:the\s+)?(?:unicode\s+)?data\s+files\s+and\s+any\s+associated\s+documentation ~ Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation
cc0-1.0 ~ 1 ~ 0.9 ~ waived ~ has\s+waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights ~ has waived all copyright and related or neighboring rights
php-3.01 ~ 2 ~ 0.8 ~ php ~ this\s+product\s+includes\s+php\s+software ~ This product includes PHP software
sendmail ~ 1 ~ 0.9 ~ sendmail ~ sendmail\s+licen[cs]e ~ the Sendmail License
smlnj ~ 1 ~ 0.9 ~ jersey ~ standard\s+ml\s+of\s+new\s+jersey\s+copyright\s+notice ~ Standard ML of New Jersey Copyright Notice, License and Disclaimer
watcom-1.0 ~ 1 ~ 0.9 ~ watcom ~ (?:sybase\s+)?open\s+watcom\s+public\s+licen[cs]e ~ Sybase Open Watcom Public License
lpl-1.02 ~ 1 ~ 0.95 ~ lucent ~ lucent\s+public\s+licen[cs]e\s+(?:version\s+)?1\.02 ~ Lucent Public License Version 1.02
lppl-1.3 ~ 1 ~ 0.9 ~ latex ~ latex\s+project\s+public\s+licen[cs]e,?\s+(?:either\s+)?version\s+1\.3[ac]? ~ LaTeX Project Public License, either version 1.3
lppl ~ 2 ~ 0.8 ~ latex ~ latex\s+project\s+public\s+licen[cs]e ~ the LaTeX Project Public License
rpsl-1.0 ~ 1 ~ 0.9 ~ realnetworks ~ realnetworks\s+public\s+source\s+licen[cs]e ~ RealNetworks Public Source License
motosoto ~ 1 ~ 0.9 ~ motosoto ~ motosoto\s+open\s+source\s+licen[cs]e ~ Motosoto Open Source License
naumen ~ 1 ~ 0.9 ~ naumen ~ naumen\s+public\s+licen[cs]e ~ NAUMEN Public License
ngpl ~ 1 ~ 0.9 ~ nethack ~ nethack\s+general\s+public\s+licen[cs]e ~ NetHack General Public License
oclc-2.0 ~ 1 ~ 0.9 ~ oclc ~ oclc\s+research\s+public\s+licen[cs]e ~ OCLC Research Public License 2.0
ldp ~ 1 ~ 0.85 ~ linux ~ linux\s+documentation\s+project\s+(?:copying\s+)?licen[cs]e ~ Linux Documentation Project Copying License
eudatagrid ~ 1 ~ 0.9 ~ datagrid ~ eu\s+datagrid\s+software\s+licen[cs]e ~ EU DataGrid Software License
entessa ~ 1 ~ 0.9 ~ entessa ~ entessa\s+public\s+licen[cs]e ~ Entessa Public License
frameworx-1.0 ~ 1 ~ 0.9 ~ frameworx ~ frameworx\s+open\s+licen[cs]e ~ Frameworx Open License 1.0
miros ~ 1 ~ 0.85 ~ miros ~ miros\s+licen[cs]e ~ The MirOS Licence
multics ~ 1 ~ 0.85 ~ multics ~ multics\s+(?:software\s+)?licen[cs]e ~ Multics License
simpl-2.0 ~ 1 ~ 0.9 ~ simple ~ simple\s+public\s+licen[cs]e(?:\s+2\.0)? ~ Simple Public License 2.0
vsl-1.0 ~ 1 ~ 0.9 ~ vovida ~ vovida\s+software\s+licen[cs]e ~ Vovida Software License
cnri-python ~ 1 ~ 0.9 ~ cnri ~ cnri\s+open\s+source\s+licen[cs]e\s+agreement ~ CNRI Open Source License Agreement
catosl-1.1 ~ 1 ~ 0.9 ~ trusted ~ computer\s+associates\s+trusted\s+open\s+source\s+licen[cs]e ~ Computer Associates Trusted Open Source License
bittorrent-1.1 ~ 1 ~ 0.9 ~ bittorrent ~ bittorrent\s+open\s+source\s+licen[cs]e ~ BitTorrent Open Source License
interbase-1.0 ~ 1 ~ 0.9 ~ interbase ~ interbase\s+public\s+licen[cs]e ~ InterBase Public License
ricoh-1.0 ~ 1 ~ 0.9 ~ ricoh ~ ricoh\s+source\s+code\s+public\s+licen[cs]e ~ Ricoh Source Code Public License
sugarcrm-1.1.3 ~ 1 ~ 0.9 ~ sugarcrm ~ sugarcrm\s+public\s+licen[cs]e ~ SugarCRM Public License
ypl-1.1 ~ 1 ~ 0.9 ~ yahoo ~ yahoo!?\s+public\s+licen[cs]e ~ Yahoo! Public License
zimbra-1.3 ~ 1 ~ 0.9 ~ zimbra ~ zimbra\s+public\s+licen[cs]e ~ Zimbra Public License
d-fsl-1.0 ~ 1 ~ 0.9 ~ german ~ german\s+free\s+software\s+licen[cs]e ~ German Free Software License
cpol-1.02 ~ 1 ~ 0.9 ~ project ~ code\s+project\s+open\s+licen[cs]e ~ The Code Project Open License
ms-lpl ~ 1 ~ 0.9 ~ microsoft ~ microsoft\s+limited\s+public\s+licen[cs]e ~ Microsoft Limited Public License
"""


def signatures() -> list[tuple[str, int, float, tuple[str, ...], str, str]]:
    """Label, priority, confidence, keywords, pattern and example of each rule."""
    out = []
    for line in SIGNATURES.strip().replace("\n ", "\0").split("\n"):
        label, priority, confidence, keywords, pattern, example = line.split(" ~ ")
        out.append((label, int(priority), float(confidence), tuple(keywords.split(",")), pattern, example.replace("\0", "\n ")))
    return out
