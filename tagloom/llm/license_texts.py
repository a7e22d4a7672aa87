"""Templates of the license scan: the public wording of licenses and notices, and statements that name one.

The texts are those that their authors publish for everyone's use; projects under one of
these licenses hold the same words.
"""

from __future__ import annotations

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(name: str, version: str, later: bool, kind: str) -> str:
    """The notice that a license of the GNU family asks for at the head of a file."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    comma = ":" if version == "3" else ";"
    return (
        f"This {kind} is free software{comma} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{',' if version == '3' else ';'} {which}. "
        f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}",),
    "MIT-0": (f"{_GRANT}. {_WARRANTY}",),
    "BSD-2-Clause": (f"{_BSD} {_BSD_WARRANTY}",),
    "BSD-3-Clause": (f"{_BSD} {_BSD_NAME} {_BSD_WARRANTY}",),
    "ISC": (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",),
    "0BSD": (f"{_ISC}. {_ISC_WARRANTY}",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "GPL-2.0-or-later": (_gnu(_GPL, "2", True, "program"),),
    "GPL-2.0-only": (_gnu(_GPL, "2", False, "program"),),
    "GPL-3.0-or-later": (_gnu(_GPL, "3", True, "program"),),
    "GPL-3.0-only": (_gnu(_GPL, "3", False, "program"),),
    "LGPL-2.1-or-later": (_gnu(_LGPL, "2.1", True, "library"),),
    "LGPL-3.0-or-later": (_gnu(_LGPL, "3", True, "library"),),
    "AGPL-3.0-or-later": (_gnu(_AGPL, "3", True, "program"),),
    "AGPL-3.0-only": (_gnu(_AGPL, "3", False, "program"),),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "EPL-1.0": ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}

#: How statements call a license.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "Apache-1.1": ("the Apache License, Version 1.1", "the Apache Software License, Version 1.1"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "0BSD": ("the BSD Zero Clause License", "the Zero-Clause BSD License"),
    "ISC": ("the ISC License",),
    "Zlib": ("the zlib License",),
    "BSL-1.0": ("the Boost Software License 1.0",),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"),
    "MPL-1.1": ("the Mozilla Public License, Version 1.1",),
    "GPL-2.0-only": (f"the {_GPL}, version 2", f"the {_GPL} v2.0"),
    "GPL-3.0-only": (f"the {_GPL}, version 3", f"the {_GPL} v3.0"),
    "GPL-2.0-or-later": (f"the {_GPL}, version 2 or later", f"the {_GPL} v2.0 or later"),
    "GPL-3.0-or-later": (f"the {_GPL}, version 3 or later", f"the {_GPL} v3.0 or later"),
    "LGPL-2.1-only": (f"the {_LGPL}, version 2.1",),
    "LGPL-3.0-only": (f"the {_LGPL}, version 3",),
    "AGPL-3.0-only": (f"the {_AGPL}, version 3",),
    "EPL-1.0": ("the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"),
    "CDDL-1.0": ("the Common Development and Distribution License, Version 1.0",),
    "EUPL-1.2": ("the European Union Public Licence, Version 1.2", "the EUPL, Version 1.2"),
    "Artistic-2.0": ("the Artistic License 2.0",),
    "OFL-1.1": ("the SIL Open Font License, Version 1.1",),
    "Python-2.0": ("the Python Software Foundation License Version 2",),
    "WTFPL": ("the WTFPL",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "the Creative Commons Zero v1.0 Universal license"),
}
for _code, _long in {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    for _v in ("3.0", "4.0"):
        NAMES[f"CC-BY{_code}-{_v}"] = (f"CC BY{_code} {_v}", f"a Creative Commons Attribution{_long} {_v} {'International' if _v == '4.0' else 'Unported'} License", f"the Creative Commons Attribution{_long} {_v} License")

#: Identifiers that are stated with a tag alone.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PHP-3.01 PostgreSQL Python-2.0 Ruby SSPL-1.0 UPL-1.0 Unicode-3.0 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()

STATEMENTS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under the terms of {}.")


def templates() -> dict[str, tuple[str, ...]]:
    """All templates by identifier: texts, statements of each name, and the tag of identifiers."""
    out: dict[str, list[str]] = {k: list(v) for k, v in TEXTS.items()}
    for name, called in NAMES.items():
        for phrase in STATEMENTS:
            for c in called:
                out.setdefault(name, []).append(phrase.format(c.replace("the terms of the terms of", "the terms of")))
    for name in IDENTIFIERS:
        out.setdefault(name, []).append(f"SPDX-License-Identifier: {name}")
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}
