"""Published licence texts, notices and openings, and the phrases that a file must hold to get the label."""

from __future__ import annotations

#: label -> (text, notice or opening as published, mandatory key phrases). Words are taken like those of a file: lower case, no punctuation.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "0bsd": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        ("with or without fee is hereby granted the software is provided",),
    ),
    "agpl-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("gnu affero general public license", "version 3"),
    ),
    "all-rights-reserved": ("All rights reserved", ("all rights reserved",)),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    "apache-2.0-header": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        ("apache license version 2 0", "you may not use this file except in compliance"),
    ),
    "artistic-2.0": (
        """This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
        ("artistic license 2 0",),
    ),
    "bsd-2-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    "bsd-3-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
        ("redistribution and use in source and binary forms", "to endorse or promote products derived from this software"),
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "bsl-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
        so, all subject to the following""",
        ("any person or organization obtaining a copy",),
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    "cc-by-nc-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ("creative commons attribution noncommercial 4 0",),
    ),
    "cc-by-nc-nd-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        ("creative commons attribution noncommercial noderivatives 4 0",),
    ),
    "cc-by-nc-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        ("creative commons attribution noncommercial sharealike 4 0",),
    ),
    "cc-by-nd-4.0": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        ("creative commons attribution noderivatives 4 0",),
    ),
    "cc-by-sa-3.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ("creative commons attribution sharealike 3 0",)),
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike 4 0",),
    ),
    "cc0-1.0": (
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
        CC0 1.0 Universal Public Domain Dedication""",
        ("waived all copyright and related or neighboring rights",),
    ),
    "epl-2.0": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at https://www.eclipse.org/legal/epl-2.0""",
        ("eclipse public license 2 0",),
    ),
    "gpl-2.0": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license", "version 2"),
    ),
    "gpl-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("gnu general public license", "version 3"),
    ),
    "gpl-3.0-notice": ("This work is licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        ("with or without fee is hereby granted provided that",),
    ),
    "lgpl-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ("gnu lesser general public license", "version 2 1"),
    ),
    "lgpl-3.0": (
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("gnu lesser general public license", "version 3"),
    ),
    "mit-notice": ("Released under the MIT License", ("mit license",)),
    "mit-full": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted", "without restriction", "the software is provided as is without warranty of any kind"),
    ),
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
        ("permission is hereby granted", "without restriction"),
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2 0",),
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
    "wtfpl": (
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
        as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE""",
        ("you want to public license",),
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ("permission is granted to anyone to use this software for any purpose including commercial applications",),
    ),
}
