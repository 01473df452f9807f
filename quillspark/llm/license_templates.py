"""Wording of public licences and notices, with markup: data for ``licenses``.

``<<beginOptional>> ... <<endOptional>>`` may be absent, ``<<var;min=n;max=m>>`` stands for any words. The texts of MIT, BSD and ISC are whole,
from the grant to the end of the disclaimer; notices are the sentences by which a work names its licence.
"""

from __future__ import annotations

# Labels and wording of public licences and notices.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "<<beginOptional>>this <<var;max=6>> is <<endOptional>>released under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    ("mit-notice", "licensed under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;min=1;max=2>>), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL <<var;min=1;max=10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 <<beginOptional>>the license <<endOptional>>"),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "<<var;min=1;max=1>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("gpl-notice", "<<beginOptional>>this <<var;max=6>> is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>gnu <<beginOptional>>lesser <<endOptional>>general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version <<var;min=1;max=1>>"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser <<endOptional>>general public license as published by the free software foundation either version <<var;min=1;max=1>> of the license or at your option any later version"),
    (
        "gpl-header",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <<var;min=1;max=1>> of the License, or (at your option) any later version. "
        "<<var;min=1;max=4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("cc-by-notice", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by <<beginOptional>>nc <<endOptional>><<beginOptional>>sa <<endOptional>><<beginOptional>>nd <<endOptional>><<var;min=1;max=1>> 0"),
    ("cc-by-notice", "licensed under a creative commons attribution <<beginOptional>>noncommercial <<endOptional>><<beginOptional>>sharealike <<endOptional>><<var;min=1;max=1>> 0 international license"),
    *(
        (
            label,
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "<<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            f"{third}"
            'THIS SOFTWARE IS PROVIDED BY <<var;min=1;max=10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
            "IN NO EVENT SHALL <<var;min=1;max=10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
            "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        )
        for label, third in (
            ("bsd-2-text", ""),
            ("bsd-3-text", "<<beginOptional>>3. <<endOptional>>Neither the name of <<var;min=1;max=10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
        )
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;min=1;max=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL <<var;min=1;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("all-rights-reserved", "copyright <<beginOptional>>c <<endOptional>><<var;max=12>> all rights reserved"),
]
