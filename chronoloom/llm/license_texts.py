"""Wordings of common licences, in lower case and without signs, for ``licenses``: whole short texts, and notices of long ones."""

from __future__ import annotations

#: (label, words, key phrases that must stand in a place)
TEXTS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (
        "mit",
        "permission is hereby granted free of charge "
        "to any person obtaining a copy of this software "
        "and associated documentation files the software "
        "to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions "
        "the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted", "free of charge"),
    ),
    (
        "mit",
        "permission is hereby granted free of charge "
        "to any person obtaining a copy of this software "
        "and associated documentation files",
        ("permission is hereby granted", "free of charge"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license "
        "you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ("in compliance with the license",),
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        ("in compliance with the license",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms "
        "with or without modification are permitted "
        "provided that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms "
        "with or without modification are permitted "
        "provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("redistribution and use", "source and binary forms"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it "
        "under the terms of the gnu general public license",
        ("gnu general public license",),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it "
        "under the terms of the gnu general public license "
        "as published by the free software foundation "
        "either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful "
        "but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
        ("gnu general public license",),
    ),
    (
        "lgpl",
        "under the terms of the gnu lesser general public license "
        "as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license "
        "as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the "
        "mozilla public license v 2 0 "
        "if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
        ("mozilla public license",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software "
        "for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice "
        "appear in all copies",
        ("permission to use copy modify", "is hereby granted"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software "
        "for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "is hereby granted"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty "
        "in no event will the authors be held liable "
        "for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose "
        "including commercial applications and to alter it "
        "and redistribute it freely subject to the following restrictions",
        ("permission is granted to anyone",),
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization "
        "obtaining a copy of the software "
        "and accompanying documentation covered by this license",
        ("person or organization",),
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    (
        "cc0",
        "the person who associated a work with this deed "
        "has dedicated the work to the public domain "
        "by waiving all of his or her rights to the work worldwide under copyright law",
        ("dedicated the work to the public domain",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain "
        "anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
