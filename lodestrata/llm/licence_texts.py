"""Names of licences by family and version, and the public texts that grant them."""

from __future__ import annotations

#: Spellings by family; the first of each is the long form used in notices.
NAMES = {
    "mit": ["the MIT License", "MIT", "MIT License", "MIT license (MIT)", "Expat (MIT)", "Expat", "X11 MIT"],
    "apache-2": ["the Apache License, version 2.0", "Apache-2.0", "Apache 2.0", "apache2", "Apache Software License 2.0", "ASL 2.0", "Apache License 2.0", "Apache License v2"],
    "apache-1.1": ["the Apache License, version 1.1", "Apache-1.1", "Apache Software License 1.1"],
    "bsd-2": ["the two-clause BSD licence", "BSD-2-Clause", "BSD 2-Clause", "2-clause BSD", "Simplified BSD License", "BSD-2", "FreeBSD License"],
    "bsd-3": ["the three-clause BSD licence", "BSD-3-Clause", "BSD 3-Clause", "3-clause BSD", "New BSD License", "Modified BSD License", "BSD-3", "Revised BSD License"],
    "isc": ["the ISC licence", "ISC", "ISC License"],
    "gpl-2": ["version 2 of the GNU General Public License", "GPL-2.0", "GPLv2", "GPL 2", "GNU GPL v2", "GNU General Public License, version 2"],
    "gpl-3": ["version 3 of the GNU General Public License", "GPL-3.0", "GPLv3", "GPL 3", "GNU GPL v3", "GNU General Public License version 3"],
    "lgpl-2.1": ["version 2.1 of the GNU Lesser General Public License", "LGPL-2.1", "LGPLv2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1"],
    "lgpl-3": ["version 3 of the GNU Lesser General Public License", "LGPL-3.0", "LGPLv3", "GNU LGPL v3", "GNU Lesser General Public License v3"],
    "agpl-3": ["version 3 of the GNU Affero General Public License", "AGPL-3.0", "AGPLv3", "GNU AGPL v3", "GNU Affero General Public License version 3"],
    "mpl-2": ["the Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "epl-1": ["the Eclipse Public License 1.0", "EPL-1.0", "EPL 1.0", "Eclipse Public License v1.0"],
    "epl-2": ["the Eclipse Public License 2.0", "EPL-2.0", "EPL 2.0", "Eclipse Public License v2.0"],
    "cc0-1": ["the CC0 1.0 Universal dedication", "CC0-1.0", "CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "unlicense": ["the Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
    "zlib": ["the zlib licence", "Zlib", "zlib/libpng License"],
    "bsl-1": ["the Boost Software License, version 1.0", "BSL-1.0", "Boost Software License 1.0"],
    "proprietary": ["a proprietary licence", "Proprietary", "LicenseRef-Proprietary", "proprietary and confidential", "Commercial", "All rights reserved proprietary"],
}
#: Families that seldom stand in a choice with others.
MORE_NAMES = {
    "gpl-1": ["version 1 of the GNU General Public License", "GPL-1.0", "GPLv1"],
    "lgpl-2": ["version 2 of the GNU Library General Public License", "LGPL-2.0", "LGPLv2", "GNU Library General Public License v2"],
    "mpl-1.1": ["the Mozilla Public License, version 1.1", "MPL-1.1", "MPL 1.1"],
    "mpl-1": ["the Mozilla Public License, version 1.0", "MPL-1.0", "MPL 1.0"],
    "bsd-4": ["the four-clause BSD licence", "BSD-4-Clause", "Original BSD License"],
    "0bsd": ["the Zero-Clause BSD licence", "0BSD", "BSD Zero Clause License"],
    "mit-0": ["the MIT No Attribution licence", "MIT-0", "MIT No Attribution"],
    "cc-by-3": ["the Creative Commons Attribution 3.0 licence", "CC-BY-3.0", "CC BY 3.0"],
    "cc-by-4": ["the Creative Commons Attribution 4.0 International licence", "CC-BY-4.0", "CC BY 4.0"],
    "cc-by-sa-4": ["the Creative Commons Attribution-ShareAlike 4.0 International licence", "CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "psf-2": ["the Python Software Foundation License, version 2", "PSF-2.0", "Python-2.0", "PSF License", "Python Software Foundation License"],
    "artistic-1": ["the Artistic License 1.0", "Artistic-1.0", "Artistic License 1.0"],
    "artistic-2": ["the Artistic License 2.0", "Artistic-2.0", "Artistic License 2.0"],
    "cddl-1": ["the Common Development and Distribution License, version 1.0", "CDDL-1.0", "CDDL 1.0"],
    "eupl-1.2": ["the European Union Public Licence, version 1.2", "EUPL-1.2", "EUPL 1.2"],
    "afl-3": ["the Academic Free License, version 3.0", "AFL-3.0", "Academic Free License v3.0"],
    "osl-3": ["the Open Software License, version 3.0", "OSL-3.0", "Open Software License 3.0"],
    "ofl-1.1": ["the SIL Open Font License, version 1.1", "OFL-1.1", "SIL OFL 1.1"],
    "wtfpl": ["the Do What The Fuck You Want To Public License", "WTFPL"],
    "ncsa": ["the University of Illinois/NCSA Open Source License", "NCSA"],
    "postgresql": ["the PostgreSQL License", "PostgreSQL"],
    "ms-pl": ["the Microsoft Public License", "MS-PL", "Ms-PL"],
    "ruby": ["the Ruby License", "Ruby"],
    "php-3": ["the PHP License, version 3.01", "PHP-3.01"],
    "sspl-1": ["the Server Side Public License, version 1", "SSPL-1.0"],
    "busl-1.1": ["the Business Source License 1.1", "BUSL-1.1"],
    "elastic-2": ["the Elastic License 2.0", "Elastic-2.0"],
    "vim": ["the Vim License", "Vim"],
    "openssl": ["the OpenSSL License", "OpenSSL"],
    "w3c": ["the W3C Software Notice and License", "W3C"],
    "mulan-2": ["the Mulan Permissive Software License, version 2", "MulanPSL-2.0", "Mulan PSL v2"],
    "blueoak-1": ["the Blue Oak Model License 1.0.0", "BlueOak-1.0.0"],
    "upl-1": ["the Universal Permissive License, version 1.0", "UPL-1.0"],
    "zpl-2.1": ["the Zope Public License, version 2.1", "ZPL-2.1"],
}

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {holders} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_KEEP = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AD = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder and its contributors."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version."
_GNU_ONLY = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} version {version} as published by the Free Software Foundation."
_GNU_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
_GNU_TITLE = "GNU {kind} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = "This work is licensed under a Creative Commons {kind} License. To view a copy of this license, visit creativecommons.org/licenses"


def _gnu(kind: str, version: str) -> list[str]:
    found = []
    for what in ("program", "library", "file", "software"):
        for colon, either in ((":", ", either"), (";", "; either")):
            found.append(_GNU.format(what=what, colon=colon, kind=kind, either=either, version=version) + " " + _GNU_WARRANTY.format(what=what, kind=kind))
            found.append(_GNU.format(what=what, colon=colon, kind=kind, either=either, version=version))
        found.append(_GNU_ONLY.format(what=what, colon=":", kind=kind, version=version))
    return found


#: Texts of licences and of the headers their authors recommend, by family.
BODIES: dict[str, list[str]] = {
    "mit": [f"{_GRANT}, {_KEEP} " + _AS_IS.format(holders=h) for h in ("AUTHORS OR COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS")] + [f"{_GRANT}, {_KEEP}"],
    "mit-0": [f"{_GRANT}. " + _AS_IS.format(holders="AUTHORS OR COPYRIGHT HOLDERS")],
    "bsd-2": [f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}", f"{_BSD_HEAD} {_BSD_1} {_BSD_2} {_BSD_END}"],
    "bsd-3": [f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_NAME} {_BSD_END}", f"{_BSD_HEAD} {_BSD_1} {_BSD_2} {_BSD_NAME} {_BSD_END}"],
    "bsd-4": [f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_AD} 4. {_BSD_NAME} {_BSD_END}"],
    "isc": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "0bsd": [f"{_ISC_GRANT}. {_ISC_END}"],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "gpl-1": _gnu("General Public License", "1"),
    "gpl-2": [*_gnu("General Public License", "2"), _GNU_TITLE.format(kind="GENERAL PUBLIC LICENSE", version="2", date="June 1991", years="1989, 1991") + " Preamble The licenses for most software are designed to take away your freedom to share and change it."],
    "gpl-3": [*_gnu("General Public License", "3"), _GNU_TITLE.format(kind="GENERAL PUBLIC LICENSE", version="3", date="29 June 2007", years="2007") + " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "lgpl-2": _gnu("Library General Public License", "2"),
    "lgpl-2.1": [*_gnu("Lesser General Public License", "2.1"), _GNU_TITLE.format(kind="LESSER GENERAL PUBLIC LICENSE", version="2.1", date="February 1999", years="1991, 1999")],
    "lgpl-3": [*_gnu("Lesser General Public License", "3"), _GNU_TITLE.format(kind="LESSER GENERAL PUBLIC LICENSE", version="3", date="29 June 2007", years="2007") + " This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "agpl-3": [*_gnu("Affero General Public License", "3"), _GNU_TITLE.format(kind="AFFERO GENERAL PUBLIC LICENSE", version="3", date="19 November 2007", years="2007") + " Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied."],
    "mpl-1": ["The contents of this file are subject to the Mozilla Public License Version 1.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied."],
    "epl-1": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT)."],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT)."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "bsl-1": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
    "cc0-1": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published from", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "cc-by-4": [_CC.format(kind="Attribution 4.0 International")],
    "cc-by-3": [_CC.format(kind="Attribution 3.0 Unported")],
    "cc-by-sa-4": [_CC.format(kind="Attribution-ShareAlike 4.0 International")],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "psf-2": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2 1. This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software in source or binary form and its associated documentation."],
    "artistic-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."],
    "cddl-1": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "eupl-1.2": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ"],
    "ms-pl": ["This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."],
    "ncsa": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers."],
    "mulan-2": ["is licensed under Mulan PSL v2. You can use this software according to the terms and conditions of the Mulan PSL v2. You may obtain a copy of Mulan PSL v2 at"],
    "sspl-1": ["This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc."],
    "upl-1": ["Licensed under the Universal Permissive License v 1.0 as shown at https://oss.oracle.com/licenses/upl"],
    "proprietary": ["All information contained herein is, and remains the property of the company. The intellectual and technical concepts contained herein are proprietary. Dissemination of this information or reproduction of this material is strictly forbidden unless prior written permission is obtained."],
}
