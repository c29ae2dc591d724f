"""Wording of licences by SPDX identifier: fixed values. Headers are what files say; bodies are (the main parts of) the texts themselves."""

from __future__ import annotations

HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

#: First lines of long licences.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

BODIES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    (
        "BSD-3-Clause",
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission. " + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION. Definitions. \"License\" shall mean the terms and conditions for use, "
        "reproduction, and distribution. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall "
        "mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. \"Source\" form shall mean the "
        "preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files. \"Object\" form shall mean any form "
        "resulting from mechanical transformation or translation of a Source form. \"Work\" shall mean the work of authorship, whether in Source or Object form, made available under "
        "the License. \"Derivative Works\" shall mean any work that is based on (or derived from) the Work and for which the editorial revisions, annotations, elaborations, or other "
        "modifications represent, as a whole, an original work of authorship. \"Contribution\" shall mean any work of authorship that is intentionally submitted to Licensor for "
        "inclusion in the Work. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute "
        "the Work and such Derivative Works. Grant of Patent License. Each Contributor hereby grants to You a patent license to make, have made, use, offer to sell, sell, import, and "
        "otherwise transfer the Work. If You institute patent litigation against any entity, then any patent licenses granted to You shall terminate as of the date such litigation is "
        "filed. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, provided that You meet "
        "the following conditions. You must retain all copyright, patent, trademark, and attribution notices. NOTICE text file. Submission of Contributions. Trademarks. Disclaimer of "
        "Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND. Limitation "
        "of Liability. Accepting Warranty or Additional Liability.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. When we speak of free software, we are referring to freedom, not price. "
        "To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights. \"This License\" refers to version 3 of the GNU General "
        "Public License. To \"modify\" a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission. A \"covered work\" means either the "
        "unmodified Program or a work based on the Program. To \"propagate\" a work means to do anything with it that would make you liable for infringement under applicable copyright "
        "law. To \"convey\" a work means any kind of propagation that enables other parties to make or receive copies. The \"source code\" for a work means the preferred form of the work "
        "for making modifications to it. \"Object code\" means any non-source form. The \"Corresponding Source\" for a work in object code form means all the source code needed to generate, "
        "install, and run the object code and to modify the work. All rights granted under this License are granted for the term of copyright on the Program. Protecting Users' Legal Rights "
        "From Anti-Circumvention Law. Conveying Verbatim Copies. Conveying Modified Source Versions. Conveying Non-Source Forms. You may convey a covered work in object code form under the "
        "terms, provided that you also convey the machine-readable Corresponding Source. A \"User Product\" is a consumer product. \"Installation Information\" for a User Product. "
        "Additional Terms. Termination. Acceptance Not Required for Having Copies. Automatic Licensing of Downstream Recipients. Patents. A \"contributor\" is a copyright holder who "
        "authorizes use under this License of the Program. No Surrender of Others' Freedom. Use with the GNU Affero General Public License. Disclaimer of Warranty. Limitation of Liability.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The "
        "licenses for most software are designed to take away your freedom to share and change it. This License applies to any program or other work which contains a notice placed by "
        "the copyright holder saying it may be distributed under the terms of this General Public License. You may copy and distribute verbatim copies of the Program's source code as you "
        "receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty. You may modify your "
        "copy or copies of the Program or any portion of it, thus forming a work based on the Program. You may copy and distribute the Program in object code or executable form. You are "
        "not required to accept this License, since you have not signed it. Each time you redistribute the Program, the recipient automatically receives a license from the original "
        "licensor. If, as a consequence of a court judgment or allegation of patent infringement, conditions are imposed on you that contradict the conditions of this License. BECAUSE THE "
        "PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW.",
    ),
    (
        "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
        "General Public License, supplemented by the additional permissions listed below. As used herein, \"this License\" refers to version 3 of the GNU Lesser General Public License. "
        "\"The Library\" refers to a covered work governed by this License. An \"Application\" is any work that makes use of an interface provided by the Library, but which is not otherwise "
        "based on the Library. A \"Combined Work\" is a work produced by combining or linking an Application with the Library. The \"Linked Version\". The \"Minimal Corresponding Source\" for "
        "a Combined Work. Exception to Section 3 of the GNU GPL. Conveying Modified Versions. Object Code Incorporating Material from Library Header Files. Combined Works. Combined "
        "Libraries. Revised Versions of the GNU Lesser General Public License.",
    ),
    (
        "AGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007. The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software. A secondary benefit of defending all users' freedom is that improvements "
        "made in alternate versions of the program, if they receive widespread use, become available for other developers to incorporate. Remote Network Interaction; Use with the GNU "
        "General Public License. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity "
        "to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge. To \"convey\" a work means any kind of "
        "propagation that enables other parties to make or receive copies. A \"covered work\" means either the unmodified Program or a work based on the Program. Conveying Verbatim "
        "Copies. Conveying Modified Source Versions. Conveying Non-Source Forms. Additional Terms. Termination. Patents. Disclaimer of Warranty. Limitation of Liability.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0. Definitions. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. "
        "\"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. \"Covered Software\" means "
        "Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form. "
        "\"Incompatible With Secondary Licenses\". \"Executable Form\" means any form of the work other than Source Code Form. \"Larger Work\" means a work that combines Covered Software with "
        "other material. \"Patent Claims\" of a Contributor. Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license. Responsibilities. Distribution of Source "
        "Form. Distribution of Executable Form. Distribution of a Larger Work. Notices. Inability to Comply Due to Statute or Regulation. Termination. Disclaimer of Warranty. Covered "
        "Software is provided under this License on an \"as is\" basis. Limitation of Liability. Litigation. Versions of the License.",
    ),
)
