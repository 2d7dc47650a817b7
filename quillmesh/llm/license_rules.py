"""The signature rules of operator 11, in the order of their tiers.

A line is `tier label keyword: pattern`. Patterns are matched against words in lower case with one space between them, from
the start of a word to the end of one; `keyword` is a word that each match holds. Tier 1 holds passages of the licenses
themselves and names with version and terms, tier 2 names with a version, tier 3 names, tier 4 notices that name none.
In a pattern `<v>` stands for an optional word for version, `<l>` for license in either spelling, `<gpl>` for the name.
"""

from __future__ import annotations

SHORT = {"<v>": "(?:version |ver |v |v(?=[0-9]))?", "<l>": "licen[cs]e", "<gpl>": "(?:gnu )?general public licen[cs]e"}

TEXT = """
1 gpl-1.0-or-later later: <gpl> <v>1(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
1 gpl-2.0-or-later later: (?:<gpl>|gpl) <v>2(?: 0)? (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 gpl-3.0-or-later later: (?:<gpl>|gpl) <v>3(?: 0)? (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 gpl-2.0-or-later either: <gpl> as published by the free software foundation either <v>2(?: 0)? (?:of the <l> )?or (?:at your option )?any later version
1 gpl-3.0-or-later either: <gpl> as published by the free software foundation either <v>3(?: 0)? (?:of the <l> )?or (?:at your option )?any later version
1 gpl-2.0-only only: (?:<gpl>|gpl) <v>2(?: 0)? only
1 gpl-3.0-only only: (?:<gpl>|gpl) <v>3(?: 0)? only
1 gpl-2.0-with-classpath-exception classpath: gpl <v>2(?: 0)? with (?:the )?classpath exception
1 gpl-with-linking-exception linking: as a special exception (?:[^ ]+ ){0,8}linking
1 lgpl-2.1-or-later lesser: (?:gnu )?lesser general public <l> <v>2 1 (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 lgpl-3.0-or-later lesser: (?:gnu )?lesser general public <l> <v>3(?: 0)? (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 lgpl-2.0-or-later library: (?:gnu )?library general public <l> <v>2(?: 0)? (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 agpl-3.0-or-later affero: (?:gnu )?affero general public <l> <v>3(?: 0)? (?:of the <l> )?or (?:at your option )?(?:any )?later(?: version)?
1 agpl-3.0-only affero: (?:gnu )?affero general public <l> <v>3(?: 0)? only
1 gpl-notice redistribute: you can redistribute it and or modify it under the terms of the <gpl>
1 gpl-notice merchantability: without even the implied warranty of merchantability or fitness for a particular purpose
1 gpl-notice received: you should have received a copy of the (?:gnu )?(?:lesser |affero |library )?general public <l>
1 apache-2.0 compliance: licensed under the apache <l> <v>2(?: 0)? (?:the <l> )?you may not use this file except in compliance
1 apache-2.0-notice compliance: you may not use this file except in compliance with the <l>
1 apache-2.0-notice governing: see the <l> for the specific language governing permissions and limitations
1 apache-2.0-with-llvm-exception llvm: apache(?: <l>)? <v>2(?: 0)? with llvm exceptions?
1 apache-1.1-notice apache: this product includes software developed by the apache (?:software foundation|group)
1 mit-text hereby: permission is hereby granted free of charge to any person obtaining a copy
1 mit-text sublicense: use copy modify merge publish distribute sublicense and or sell copies
1 mit-text portions: shall be included in all copies or substantial portions of the software
1 mit-0 attribution: mit no attribution
1 isc-text fee: permission to use copy modify and or distribute this software for any purpose with or without fee
1 hpnd-text fee: permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee
1 bsd-text redistribution: redistribution and use in source and binary forms with or without modification are permitted
1 bsd-text reproduce: redistributions in binary form must reproduce the above copyright notice
1 bsd-text retain: redistributions of source code must retain the above copyright notice
1 bsd-3-clause-text endorse: may be used to endorse or promote products derived from this software
1 bsd-4-clause-text advertising: all advertising materials mentioning features or use of this software
1 zlib-text misrepresented: the origin of this software must not be misrepresented
1 zlib-text altered: altered source versions must be plainly marked
1 zlib-text express: this software is provided as is without any express or implied warranty
1 unlicense-text unencumbered: this is free and unencumbered software released into the public domain
1 wtfpl-text fuck: you just do what the fuck you want to
1 beerware-text beer: you can buy me a beer in return
1 mpl-2.0-text mpl: if a copy of the mpl was not distributed with this file
1 mpl-2.0-text mozilla: this source code form is subject to the terms of the mozilla public <l> <v>2(?: 0)?
1 mpl-1.1-text mozilla: the contents of this file are subject to the mozilla public <l>
1 epl-text eclipse: made available under the terms of the eclipse public <l>
1 cddl-text cddl: the contents of this file are subject to the terms of the (?:cddl|common development and distribution <l>)
1 boost-text boost: distributed under the boost software <l>
1 cc0-text waived: has waived all copyright and related or neighboring rights
1 cc-by-text appropriate: you must give appropriate credit provide a link
1 cc-by-sa-text remix: if you remix transform or build upon the material you must distribute
1 cc-nc-text commercial: you may not use the material for commercial purposes
1 cc-nd-text transform: if you remix transform or build upon the material you may not distribute
1 odbl-text database: produced works? from the database
1 ofl-text reserved: with reserved font name
1 gfdl-text invariant: with no invariant sections
1 ms-pl-text conditions: reciprocal grants? (?:[^ ]+ ){0,4}conditions
1 as-is-text particular: warranties of merchantability fitness for a particular purpose and (?:non ?)?infringement
1 spdx-mit spdx: spdx <l> identifier mit
1 spdx-apache-2.0 spdx: spdx <l> identifier apache 2 0
1 spdx-gpl-2.0 spdx: spdx <l> identifier gpl 2 0(?: only| or later)?
1 spdx-gpl-3.0 spdx: spdx <l> identifier gpl 3 0(?: only| or later)?
1 spdx-lgpl-2.1 spdx: spdx <l> identifier lgpl 2 1(?: only| or later)?
1 spdx-lgpl-3.0 spdx: spdx <l> identifier lgpl 3 0(?: only| or later)?
1 spdx-agpl-3.0 spdx: spdx <l> identifier agpl 3 0(?: only| or later)?
1 spdx-bsd-2-clause spdx: spdx <l> identifier bsd 2 clause
1 spdx-bsd-3-clause spdx: spdx <l> identifier bsd 3 clause
1 spdx-mpl-2.0 spdx: spdx <l> identifier mpl 2 0
1 spdx-isc spdx: spdx <l> identifier isc
1 spdx-cc0-1.0 spdx: spdx <l> identifier cc0 1 0
1 spdx-cc-by spdx: spdx <l> identifier cc by [0-9] [0-9]
1 spdx-unlicense spdx: spdx <l> identifier unlicense
2 gpl-1.0 general: <gpl> <v>1(?: 0)?
2 gpl-2.0 general: <gpl> <v>2(?: 0)?
2 gpl-3.0 general: <gpl> <v>3(?: 0)?
2 gpl-1.0 gpl: gpl <v>1(?: 0)?
2 gpl-2.0 gpl: gpl <v>2(?: 0)?
2 gpl-3.0 gpl: gpl <v>3(?: 0)?
2 gpl-2.0 gplv2: gplv2
2 gpl-3.0 gplv3: gplv3
2 gpl-2.0 gpl2: gpl2
2 gpl-3.0 gpl3: gpl3
2 lgpl-2.0 library: (?:gnu )?library general public <l> <v>2(?: 0)?
2 lgpl-2.1 lesser: (?:gnu )?lesser general public <l> <v>2 1
2 lgpl-3.0 lesser: (?:gnu )?lesser general public <l> <v>3(?: 0)?
2 lgpl-2.1 lgpl: lgpl <v>2 1
2 lgpl-3.0 lgpl: lgpl <v>3(?: 0)?
2 lgpl-2.1 lgplv2: lgplv2(?: 1)?
2 lgpl-3.0 lgplv3: lgplv3
2 agpl-3.0 affero: (?:gnu )?affero general public <l> <v>3(?: 0)?
2 agpl-1.0 affero: affero general public <l> <v>1(?: 0)?
2 agpl-3.0 agpl: agpl <v>3(?: 0)?
2 agpl-3.0 agplv3: agplv3
2 gfdl-1.1 documentation: (?:gnu )?free documentation <l> <v>1 1
2 gfdl-1.2 documentation: (?:gnu )?free documentation <l> <v>1 2
2 gfdl-1.3 documentation: (?:gnu )?free documentation <l> <v>1 3
2 apache-1.0 apache: apache (?:software )?<l> <v>1 0
2 apache-1.1 apache: apache (?:software )?<l> <v>1 1
2 apache-2.0 apache: apache (?:software )?<l> <v>2(?: 0)?
2 apache-2.0 apache: apache 2 0(?: <l>)?
2 apache-2.0 asl: asl <v>2(?: 0)?
2 apache-2.0 apache2: apache2(?: <l>)?
2 cc-by-1.0 by: (?:cc|creative commons) by 1 0
2 cc-by-2.0 by: (?:cc|creative commons) by 2 0
2 cc-by-2.5 by: (?:cc|creative commons) by 2 5
2 cc-by-3.0 by: (?:cc|creative commons) by 3 0
2 cc-by-4.0 by: (?:cc|creative commons) by 4 0
2 cc-by-sa-2.0 sa: (?:cc|creative commons) by sa 2 0
2 cc-by-sa-2.5 sa: (?:cc|creative commons) by sa 2 5
2 cc-by-sa-3.0 sa: (?:cc|creative commons) by sa 3 0
2 cc-by-sa-4.0 sa: (?:cc|creative commons) by sa 4 0
2 cc-by-nc-2.0 nc: (?:cc|creative commons) by nc 2 0
2 cc-by-nc-2.5 nc: (?:cc|creative commons) by nc 2 5
2 cc-by-nc-3.0 nc: (?:cc|creative commons) by nc 3 0
2 cc-by-nc-4.0 nc: (?:cc|creative commons) by nc 4 0
2 cc-by-nd-2.0 nd: (?:cc|creative commons) by nd 2 0
2 cc-by-nd-3.0 nd: (?:cc|creative commons) by nd 3 0
2 cc-by-nd-4.0 nd: (?:cc|creative commons) by nd 4 0
2 cc-by-nc-sa-2.0 sa: (?:cc|creative commons) by nc sa 2 0
2 cc-by-nc-sa-3.0 sa: (?:cc|creative commons) by nc sa 3 0
2 cc-by-nc-sa-4.0 sa: (?:cc|creative commons) by nc sa 4 0
2 cc-by-nc-nd-2.0 nd: (?:cc|creative commons) by nc nd 2 0
2 cc-by-nc-nd-3.0 nd: (?:cc|creative commons) by nc nd 3 0
2 cc-by-nc-nd-4.0 nd: (?:cc|creative commons) by nc nd 4 0
2 cc-by-4.0 attribution: creative commons attribution (?:<l> )?4 0(?: international)?
2 cc-by-3.0 attribution: creative commons attribution (?:<l> )?3 0(?: unported)?
2 cc-by-sa-4.0 sharealike: creative commons attribution sharealike 4 0(?: international)?
2 cc-by-sa-3.0 sharealike: creative commons attribution sharealike 3 0(?: unported)?
2 cc-by-nc-4.0 noncommercial: creative commons attribution noncommercial 4 0(?: international)?
2 cc-by-nc-3.0 noncommercial: creative commons attribution noncommercial 3 0(?: unported)?
2 cc-by-nc-sa-4.0 sharealike: creative commons attribution noncommercial sharealike 4 0(?: international)?
2 cc-by-nc-nd-4.0 noderivatives: creative commons attribution noncommercial noderivatives 4 0(?: international)?
2 cc-by-nd-4.0 noderivatives: creative commons attribution noderivatives 4 0(?: international)?
2 cc0-1.0 cc0: cc0 1 0(?: universal)?
2 mpl-1.0 mozilla: mozilla public <l> <v>1 0
2 mpl-1.1 mozilla: mozilla public <l> <v>1 1
2 mpl-2.0 mozilla: mozilla public <l> <v>2(?: 0)?
2 mpl-1.1 mpl: mpl <v>1 1
2 mpl-2.0 mpl: mpl <v>2(?: 0)?
2 epl-1.0 eclipse: eclipse public <l> <v>1(?: 0)?
2 epl-2.0 eclipse: eclipse public <l> <v>2(?: 0)?
2 epl-1.0 epl: epl <v>1(?: 0)?
2 epl-2.0 epl: epl <v>2(?: 0)?
2 edl-1.0 eclipse: eclipse distribution <l> <v>1(?: 0)?
2 cddl-1.0 distribution: common development and distribution <l> <v>1 0
2 cddl-1.1 distribution: common development and distribution <l> <v>1 1
2 cddl-1.0 cddl: cddl <v>1 0
2 cpl-1.0 common: common public <l> <v>1(?: 0)?
2 eupl-1.1 european: european union public <l> <v>1 1
2 eupl-1.2 european: european union public <l> <v>1 2
2 eupl-1.2 eupl: eupl <v>1 2
2 artistic-1.0 artistic: artistic <l> <v>1(?: 0)?
2 artistic-2.0 artistic: artistic <l> <v>2(?: 0)?
2 afl-2.1 academic: academic free <l> <v>2 1
2 afl-3.0 academic: academic free <l> <v>3(?: 0)?
2 osl-3.0 open: open software <l> <v>3(?: 0)?
2 boost-1.0 boost: boost software <l> <v>1(?: 0)?
2 ofl-1.1 sil: sil open font <l> <v>1 1
2 odbl-1.0 database: open database <l> <v>1(?: 0)?
2 python-2.0 python: python (?:software foundation )?<l> <v>2(?: 0)?
2 php-3.01 php: php <l> <v>3 (?:01|0)
2 lppl-1.3 latex: latex project public <l> <v>1 3c?
2 bsd-0-clause bsd: (?:0|zero) clause bsd(?: <l>)?
2 bsd-1-clause bsd: (?:1|one) clause bsd(?: <l>)?
2 bsd-2-clause bsd: (?:2|two) clause bsd(?: <l>)?
2 bsd-3-clause bsd: (?:3|three) clause bsd(?: <l>)?
2 bsd-4-clause bsd: (?:4|four) clause bsd(?: <l>)?
2 bsd-0-clause 0bsd: 0bsd
2 bsd-2-clause bsd: bsd 2 clause(?: <l>)?
2 bsd-3-clause bsd: bsd 3 clause(?: <l>)?
2 bsd-4-clause bsd: bsd 4 clause(?: <l>)?
2 bsd-3-clause bsd: (?:new|modified|revised) bsd(?: <l>)?
2 bsd-2-clause bsd: (?:simplified|freebsd) bsd(?: <l>)?
3 gpl general: <gpl>
3 gpl gpl: (?:gnu )?gpl
3 lgpl lesser: (?:gnu )?lesser general public <l>
3 lgpl lgpl: (?:gnu )?lgpl
3 agpl affero: (?:gnu )?affero general public <l>
3 agpl agpl: (?:gnu )?agpl
3 gfdl documentation: (?:gnu )?free documentation <l>
3 apache apache: apache (?:software )?<l>
3 mit mit: (?:released |licensed )?(?:under )?(?:the )?mit <l>
3 mit expat: expat <l>
3 x11 x11: x11 <l>
3 bsd bsd: bsd(?: style)? <l>
3 cc-by by: (?:cc|creative commons) by
3 cc-by-nc nc: (?:cc|creative commons) by nc
3 cc-by-sa sa: (?:cc|creative commons) by (?:nc )?sa
3 cc-by-nd nd: (?:cc|creative commons) by (?:nc )?nd
3 cc-by attribution: creative commons attribution
3 creative-commons commons: creative commons(?: <l>)?
3 cc0 cc0: cc0
3 mpl mozilla: mozilla public <l>
3 epl eclipse: eclipse public <l>
3 isc isc: isc <l>
3 zlib zlib: zlib(?: libpng)? <l>
3 unlicense unlicense: (?:the )?unlicense
3 wtfpl wtfpl: wtfpl
3 artistic artistic: artistic <l>
3 ofl sil: sil open font <l>
3 public-domain domain: public domain
4 license-reference under: (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?
4 copyright-notice copyright: copyright (?:c )?(?:19|20)[0-9][0-9]
4 copyright-notice copyright: copyright
4 all-rights-reserved reserved: all rights reserved
4 warranty-disclaimer warranty: without (?:any )?warranty
4 as-is provided: provided as is
4 proprietary confidential: proprietary and confidential
4 no-license permission: no part of (?:[^ ]+ ){1,6}without (?:[^ ]+ ){0,4}permission
"""


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, keyword, pattern) of each rule, in order."""
    out = []
    for line in TEXT.strip().splitlines():
        head, pattern = line.split(": ", 1)
        tier, label, keyword = head.split(" ")
        for short, long in SHORT.items():
            pattern = pattern.replace(short, long)
        out.append((int(tier), label, keyword, pattern.strip()))
    return out
