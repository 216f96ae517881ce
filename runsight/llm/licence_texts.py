"""Public licence texts and notices, and spellings that count as equal."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_0BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""

KNOWN = {
    "MIT": _MIT,
    "MIT (titled)": "MIT License\n\n" + _MIT,
    "ISC": _ISC + _NO_WARRANTY,
    "ISC (titled)": "ISC License\n\n" + _ISC + _NO_WARRANTY,
    "0BSD": _0BSD + _NO_WARRANTY,
    "notice Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice MIT": "Released under the MIT License.",
}

_BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_BSD_3RD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

COMMON = {
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-2-Clause (titled)": "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + _BSD_3RD + _BSD_END,
    "BSD-3-Clause (titled)": "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3RD + _BSD_END,
    "BSL-1.0": _BOOST,
    "Unlicense": _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>",
    "Zlib": _ZLIB,
    "Zlib (titled)": "zlib License\n\n" + _ZLIB,
    "header Apache-2.0": _APACHE_HEADER,
    "header MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "notice Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License");',
}
"""Further texts, known beside `KNOWN`."""

COMMON_DIGESTS = {
    "949a7b2ca212ee17e4c8952aba2a29d03724b803529db7cf60597550d6008283": "Apache-2.0",
    "9475155ff6ce9d08e3e704d636c3b015934a1c768cc10fa0c95abb3075f86de3": "Apache-2.0",
    "15dfa46e3be740a924fb2f10a350b184be810116728a9a0f7a1102ed556c85a1": "Apache-2.0 (without appendix)",
    "0d55c34f704694729e228539a324c6396d3e555926cfd50471c4a286d5eff35b": "Apache-2.0 (without appendix)",
    "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c": "CC0-1.0",
    "73a13dcbe1ed76f940bf43896efdd96280f583c00f2794bf93609fd3accf573d": "CC0-1.0",
    "90d0f6a20987abc2028de99ca57a3c6a23a5cdabca769277aa72fce2b8b618e3": "GPL-2.0",
    "343fffad4187d1bae7c872b59832b41e762657dc4acdee6a6f0259da3df1cd00": "GPL-2.0",
    "261fdcf3f7e3433204252c856a191e81a46f009c47e7b62c400a51cc05bd450a": "GPL-2.0 (without appendix)",
    "ac29ff91b200890a154300f26d79e808bf757e0de4235f33c60c9a49ec4d7377": "GPL-2.0 (without appendix)",
    "6c6ea98c6c4fcacb30dfff389dcd6e48ad82a8ad55ad8d064ceadd4ab86ba5a0": "GPL-3.0",
    "318825e237b710988c5e6f5e899edd6df5be6e06270e219f1b80078bd589ad3e": "GPL-3.0",
    "79c2fc1717475e2a05b0f0b2fb7b97e9d4927dfa4781d94792f03908f39440a6": "GPL-3.0 (without appendix)",
    "8929555c5d5b504c85ba6e4918482ab9899632fe5417edced5248d425960dbc0": "GPL-3.0 (without appendix)",
    "4c081d24947bf70b2bb0f5bbe14c3c2736c23c60bcc727ac32f1781510ebda5d": "LGPL-2.1",
    "8c1aab1135b10e0ac64874541815cc11ea7705ef5a15cb2c160eee53c5778036": "LGPL-2.1",
    "3beb0300a7609806481b52d07ba995e4b665d549ce6460c6c156e59240a833be": "LGPL-2.1 (without appendix)",
    "c2284fa80234454b1f464e0e9dcf2b616905aa5eafd910746cda56becd2a6ca2": "LGPL-2.1 (without appendix)",
    "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45": "LGPL-3.0",
    "599e236ddcb69302837061770c9ad5f7b2e9908bdde58f1d38401c54304f7934": "LGPL-3.0",
    "115c0ae57e100b00c2b6e84d27f884a7d6e862c320de5429b8320f484f9e3f28": "MPL-2.0",
}
"""Digests of the canonical form of long texts, with their titles and without."""

EQUIVALENT = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sub license": "sublicense",
    "non infringement": "noninfringement",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "favour": "favor",
    "http": "https",
}

BEGINNINGS = [
    "permission is hereby granted free of charge",
    "permission to use copy modify",
    "redistribution and use in source and binary forms",
    "this is free and unencumbered software",
    "this software is provided as is without any express or implied warranty",
    "licensed under the apache license",
    "this source code form is subject to the terms of the mozilla public license",
    "everyone is permitted to copy and distribute verbatim copies",
    "terms and conditions for use reproduction and distribution",
    "creative commons corporation is not a law firm",
]
"""The first words of licences' own texts, behind titles and notices, in canonical form."""

NAMED_TITLES = ["creative commons legal code", "cc0 1 0 universal", "zlib", "mit", "isc", "expat", "the unlicense", "unlicense"]
"""Titles without the word licence, in canonical form."""
