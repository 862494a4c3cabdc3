"""Display names of languages by file name: the whole catalogue of lexers of pygments 2.21.0, generated once."""

# fixed values: by full file name
LANGUAGE_BY_NAME = {
    ".Renviron": "S",
    ".Rhistory": "S",
    ".Rprofile": "S",
    ".SRCINFO": "Srcinfo",
    ".bashrc": "Bash",
    ".csl": "Kusto",
    ".editorconfig": "INI",
    ".exrc": "VimL",
    ".gvimrc": "VimL",
    ".htaccess": "ApacheConf",
    ".kshrc": "Bash",
    ".ldaprc": "LDAP configuration file",
    ".vimrc": "VimL",
    ".zshrc": "Bash",
    "Android.bp": "Soong",
    "BUCK": "Python",
    "BUILD": "Python",
    "BUILD.bazel": "Python",
    "CMakeLists.txt": "CMake",
    "Caddyfile": "Caddyfile",
    "Dockerfile": "Docker",
    "GNUmakefile": "Makefile",
    "Gemfile": "Ruby",
    "Makefile": "Makefile",
    "PKGBUILD": "Bash",
    "Pipfile": "TOML",
    "Pipfile.lock": "JSON",
    "Procfile": "Procfile",
    "Rakefile": "Ruby",
    "SConscript": "Python",
    "SConstruct": "Python",
    "Singularity": "Singularity",
    "Vagrantfile": "Ruby",
    "WORKSPACE": "Python",
    "_exrc": "VimL",
    "_gvimrc": "VimL",
    "_vimrc": "VimL",
    "apache.conf": "ApacheConf",
    "apache2.conf": "ApacheConf",
    "autodelegate": "Myghty",
    "autohandler": "Mason",
    "bashrc": "Bash",
    "control": "Debian Control file",
    "dhandler": "Mason",
    "gvimrc": "VimL",
    "id_dsa": "ASCII armored",
    "id_ecdsa": "ASCII armored",
    "id_ecdsa_sk": "ASCII armored",
    "id_ed25519": "ASCII armored",
    "id_ed25519_sk": "ASCII armored",
    "id_rsa": "ASCII armored",
    "kshrc": "Bash",
    "ldap.conf": "LDAP configuration file",
    "ldaprc": "LDAP configuration file",
    "lighttpd.conf": "Lighttpd configuration file",
    "makefile": "Makefile",
    "meson.build": "Meson",
    "meson.options": "Meson",
    "meson_options.txt": "Meson",
    "nginx.conf": "Nginx configuration file",
    "pacman.conf": "PacmanConf",
    "poetry.lock": "TOML",
    "sources.list": "Debian Sourcelist",
    "squid.conf": "SquidConf",
    "standard-modules.in": "Kconfig",
    "termcap": "Termcap",
    "termcap.src": "Termcap",
    "terminfo": "Terminfo",
    "terminfo.src": "Terminfo",
    "todo.txt": "Todotxt",
    "vimrc": "VimL",
    "xorg.conf": "Xorg",
    "zshrc": "Bash",
}

# fixed values: by ending, or by a pattern where there is a star; where several fit, the last one counts
LANGUAGE_BY_ENDING = {
    ".ABAP": "ABAP",
    ".abap": "ABAP",
    ".isa": "AMDGPU",
    ".apl": "APL",
    ".aplc": "APL",
    ".aplf": "APL",
    ".apli": "APL",
    ".apln": "APL",
    ".aplo": "APL",
    ".dyalog": "APL",
    ".abnf": "ABNF",
    ".as": "ActionScript",
    ".ada": "Ada",
    ".adb": "Ada",
    ".ads": "Ada",
    ".adl": "ADL",
    ".adlf": "ADL",
    ".adls": "ADL",
    ".adlx": "ADL",
    ".agda": "Agda",
    ".aheui": "Aheui",
    ".als": "Alloy",
    ".at": "AmbientTalk",
    ".run": "Ampl",
    ".ng2": "HTML + Angular2",
    ".G": "ANTLR With Ruby Target",
    ".applescript": "AppleScript",
    ".arw": "Arrow",
    ".art": "Arturo",
    ".asc": "ASCII armored",
    ".pem": "ASCII armored",
    ".asn1": "ASN.1",
    ".aj": "AspectJ",
    ".asy": "Asymptote",
    ".aug": "Augeas",
    ".au3": "AutoIt",
    ".ahk": "autohotkey",
    ".ahkl": "autohotkey",
    ".awk": "Awk",
    ".bbc": "BBC Basic",
    ".bc": "BC",
    ".bqn": "BQN",
    ".bst": "BST",
    ".bare": "BARE",
    ".bash": "Bash",
    ".ebuild": "Bash",
    ".eclass": "Bash",
    ".exheres-0": "Bash",
    ".exlib": "Bash",
    ".ksh": "Bash",
    ".sh": "Bash",
    ".zsh": "Bash",
    ".bash_*": "Bash",
    "bash_*": "Bash",
    ".sh-session": "Bash Session",
    ".shell-session": "Bash Session",
    ".bat": "Batchfile",
    ".cmd": "Batchfile",
    ".befunge": "Befunge",
    ".be": "Berry",
    ".bib": "BibTeX",
    ".bbappend": "BitBake",
    ".bbclass": "BitBake",
    ".bb": "BlitzBasic",
    ".decls": "BlitzBasic",
    ".bmx": "BlitzMax",
    ".blp": "Blueprint",
    ".bnf": "BNF",
    ".boa": "Boa",
    ".boo": "Boo",
    ".bpl": "Boogie",
    ".bf": "Brainfuck",
    ".camkes": "CAmkES",
    ".idl4": "CAmkES",
    ".cel": "CEL",
    ".cmake": "CMake",
    ".c-objdump": "c-objdump",
    ".cpsa": "CPSA",
    ".cssul4": "CSS+UL4",
    ".cs": "C#",
    ".cadl": "cADL",
    ".cdl": "CapDL",
    ".capnp": "Cap'n Proto",
    ".carbon": "Carbon",
    ".cddl": "CDDL",
    ".ceylon": "Ceylon",
    ".cf": "CFEngine3",
    ".chai": "ChaiScript",
    ".chpl": "Chapel",
    ".spt": "Cheetah",
    ".tmpl": "Cheetah",
    ".cirru": "Cirru",
    ".clay": "Clay",
    ".dcl": "Clean",
    ".icl": "Clean",
    ".clj": "Clojure",
    ".cljc": "Clojure",
    ".cljs": "ClojureScript",
    ".CBL": "COBOLFree",
    ".cbl": "COBOLFree",
    ".COB": "COBOL",
    ".CPY": "COBOL",
    ".cob": "COBOL",
    ".cpy": "COBOL",
    ".ql": "CodeQL",
    ".qll": "CodeQL",
    ".coffee": "CoffeeScript",
    ".cfc": "Coldfusion CFC",
    ".cfm": "Coldfusion HTML",
    ".cfml": "Coldfusion HTML",
    ".cml": "COMAL-80",
    ".comal": "COMAL-80",
    ".lisp": "Common Lisp",
    ".cps": "Component Pascal",
    ".P": "cplint",
    ".cpl": "cplint",
    ".lpad": "cplint",
    ".c++-objdump": "cpp-objdump",
    ".cpp-objdump": "cpp-objdump",
    ".cxx-objdump": "cpp-objdump",
    ".crmsh": "Crmsh",
    ".pcmk": "Crmsh",
    ".croc": "Croc",
    ".cry": "Cryptol",
    ".cr": "Crystal",
    ".csd": "Csound Document",
    ".orc": "Csound Orchestra",
    ".udo": "Csound Orchestra",
    ".sco": "Csound Score",
    ".css.j2": "CSS+Django/Jinja",
    ".css.jinja2": "CSS+Django/Jinja",
    ".css": "CSS",
    ".cyp": "Cypher",
    ".cypher": "Cypher",
    ".pxd": "Cython",
    ".pxi": "Cython",
    ".pyx": "Cython",
    ".d": "D",
    ".di": "D",
    ".d-objdump": "d-objdump",
    ".darcspatch": "Darcs Patch",
    ".dpatch": "Darcs Patch",
    ".dart": "Dart",
    ".dasm": "DASM16",
    ".dasm16": "DASM16",
    ".dax": "Dax",
    ".sources": "Debian Sources file",
    ".dpr": "Delphi",
    ".pas": "Delphi",
    ".desktop": "Desktop file",
    ".dts": "Devicetree",
    ".dtsi": "Devicetree",
    ".dg": "dg",
    ".diff": "Diff",
    ".patch": "Diff",
    ".zone": "Zone",
    ".docker": "Docker",
    ".dtd": "DTD",
    ".duel": "Duel",
    ".jbst": "Duel",
    ".dylan-console": "Dylan session",
    ".dyl": "Dylan",
    ".dylan": "Dylan",
    ".intr": "Dylan",
    ".hdp": "DylanLID",
    ".lid": "DylanLID",
    ".eg": "Earl Grey",
    ".ezt": "Easytrieve",
    ".ebnf": "EBNF",
    ".e": "Eiffel",
    ".eex": "Elixir",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".leex": "Elixir",
    ".elm": "Elm",
    ".elpi": "Elpi",
    ".el": "EmacsLisp",
    ".eml": "E-mail",
    ".erl": "Erlang",
    ".es": "Erlang",
    ".escript": "Erlang",
    ".hrl": "Erlang",
    ".erl-sh": "Erlang erl session",
    ".evoque": "Evoque",
    ".exec": "execline",
    ".fsi": "F#",
    ".fsx": "F#",
    ".fst": "FStar",
    ".fsti": "FStar",
    ".factor": "Factor",
    ".fancypack": "Fancy",
    ".fy": "Fancy",
    ".fan": "Fantom",
    ".flx": "Felix",
    ".flxh": "Felix",
    ".fnl": "Fennel",
    ".fnlm": "Fennel",
    ".fif": "Fift",
    ".fish": "Fish",
    ".load": "Fish",
    ".flo": "FloScript",
    ".frt": "Forth",
    ".fs": "Forth",
    ".F": "FortranFixed",
    ".f": "FortranFixed",
    ".F03": "Fortran",
    ".F90": "Fortran",
    ".f03": "Fortran",
    ".f90": "Fortran",
    ".PRG": "FoxPro",
    ".prg": "FoxPro",
    ".fc": "FunC",
    ".func": "FunC",
    ".fut": "Futhark",
    ".g": "GAP",
    ".gap": "GAP",
    ".gi": "GAP",
    ".gd": "GDScript",
    ".frag": "GLSL",
    ".geo": "GLSL",
    ".vert": "GLSL",
    ".gsql": "GSQL",
    ".s": "GAS",
    ".gcode": "g-code",
    ".kid": "Genshi",
    ".po": "Gettext Catalog",
    ".pot": "Gettext Catalog",
    ".feature": "Gherkin",
    ".gleam": "Gleam",
    ".plot": "Gnuplot",
    ".plt": "Gnuplot",
    ".go": "Go",
    ".golo": "Golo",
    ".gdc": "GoodData-CL",
    ".googlesql": "GoogleSQL",
    ".googlesql.sql": "GoogleSQL",
    ".gs": "Gosu",
    ".gsp": "Gosu",
    ".gsx": "Gosu",
    ".vark": "Gosu",
    ".gst": "Gosu Template",
    ".graphql": "GraphQL",
    ".dot": "Graphviz",
    ".gv": "Graphviz",
    ".1": "Groff",
    ".1p": "Groff",
    ".2": "Groff",
    ".3": "Groff",
    ".3pm": "Groff",
    ".4": "Groff",
    ".5": "Groff",
    ".6": "Groff",
    ".7": "Groff",
    ".8": "Groff",
    ".9": "Groff",
    ".man": "Groff",
    ".gradle": "Groovy",
    ".groovy": "Groovy",
    ".hlsl": "HLSL",
    ".hlsli": "HLSL",
    ".htmlul4": "HTML+UL4",
    ".haml": "Haml",
    ".handlebars": "HTML+Handlebars",
    ".hbs": "HTML+Handlebars",
    ".ha": "Hare",
    ".hs": "Haskell",
    ".hx": "Haxe",
    ".hxsl": "Haxe",
    ".hsail": "HSAIL",
    "*Spec.hs": "Hspec",
    ".htm.j2": "HTML+Django/Jinja",
    ".htm.jinja2": "HTML+Django/Jinja",
    ".html.j2": "HTML+Django/Jinja",
    ".html.jinja2": "HTML+Django/Jinja",
    ".xhtml.j2": "HTML+Django/Jinja",
    ".xhtml.jinja2": "HTML+Django/Jinja",
    ".htm": "HTML",
    ".html": "HTML",
    ".xhtml": "HTML",
    ".phtml": "HTML+PHP",
    ".hxml": "Hxml",
    ".hy": "Hy",
    ".hyb": "Hybris",
    ".ICON": "Icon",
    ".icon": "Icon",
    ".idr": "Idris",
    ".ipf": "Igor",
    ".i6t": "Inform 6 template",
    ".i7x": "Inform 7",
    ".ni": "Inform 7",
    ".cfg": "INI",
    ".inf": "INI",
    ".ini": "INI",
    ".io": "Io",
    ".ik": "Ioke",
    ".weechatlog": "IRC logs",
    ".thy": "Isabelle",
    ".ijs": "J",
    ".jp": "JMESPath",
    ".jslt": "JSLT",
    ".bug": "JAGS",
    ".jag": "JAGS",
    ".janet": "Janet",
    ".jdn": "Janet",
    ".java": "Java",
    ".js.j2": "JavaScript+Django/Jinja",
    ".js.jinja2": "JavaScript+Django/Jinja",
    ".cjs": "JavaScript",
    ".js": "JavaScript",
    ".jsm": "JavaScript",
    ".mjs": "JavaScript",
    ".jsul4": "Javascript+UL4",
    ".jcl": "JCL",
    ".jsgf": "JSGF",
    ".json5": "JSON5",
    ".jsonld": "JSON-LD",
    ".json": "JSON",
    ".jsonl": "JSON",
    ".module": "JSON",
    ".ndjson": "JSON",
    ".xc": "JSON",
    ".jsonnet": "Jsonnet",
    ".libsonnet": "Jsonnet",
    ".jsp": "Java Server Page",
    ".jsx": "JSX",
    ".react": "JSX",
    ".jl": "Julia",
    ".juttle": "Juttle",
    ".k": "K",
    ".kal": "Kal",
    "*Config.in*": "Kconfig",
    "Kconfig*": "Kconfig",
    "external.in*": "Kconfig",
    ".dmesg": "Kernel log",
    ".kmsg": "Kernel log",
    ".kk": "Koka",
    ".kki": "Koka",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".kn": "Kuin",
    ".kql": "Kusto",
    ".kusto": "Kusto",
    ".lsl": "LSL",
    ".lasso": "Lasso",
    ".lasso8": "Lasso",
    ".lasso9": "Lasso",
    ".ldif": "LDIF",
    ".lean": "Lean4",
    ".less": "LessCss",
    ".ly": "LilyPond",
    ".b": "Limbo",
    ".liquid": "liquid",
    ".lagda": "Literate Agda",
    ".lcry": "Literate Cryptol",
    ".lhs": "Literate Haskell",
    ".lidr": "Literate Idris",
    ".ls": "LiveScript",
    ".ll": "LLVM",
    ".mir": "LLVM-MIR",
    ".lgt": "Logtalk",
    ".logtalk": "Logtalk",
    ".lua": "Lua",
    ".wlua": "Lua",
    ".luau": "Luau",
    ".mcfunction": "MCFunction",
    ".mcschema": "MCSchema",
    ".MIPS": "MIPS",
    ".mips": "MIPS",
    ".moo": "MOOCode",
    ".m2": "Macaulay2",
    ".mak": "Makefile",
    ".mk": "Makefile",
    "Makefile.*": "Makefile",
    ".mao": "Mako",
    ".mpl": "Maple",
    ".maql": "MAQL",
    ".markdown": "Markdown",
    ".md": "Markdown",
    ".mask": "Mask",
    ".mc": "Mason",
    ".mhtml": "Mason",
    ".mi": "Mason",
    ".cdf": "Mathematica",
    ".ma": "Mathematica",
    ".nb": "Mathematica",
    ".nbp": "Mathematica",
    ".wl": "Mathematica",
    ".wls": "Mathematica",
    ".mac": "Maxima",
    ".max": "Maxima",
    ".ms": "MiniScript",
    ".mo": "Modelica",
    ".mod": "Modula-2",
    ".mojo": "Mojo",
    ".🔥": "Mojo",
    ".monkey": "Monkey",
    ".mt": "Monte",
    ".moon": "MoonScript",
    ".mos": "Mosel",
    ".css.in": "CSS+mozpreproc",
    ".js.in": "Javascript+mozpreproc",
    ".xul.in": "XUL+mozpreproc",
    ".msc": "Mscgen",
    ".mu": "MuPAD",
    ".mxml": "MXML",
    ".myt": "Myghty",
    ".ncl": "NCL",
    ".nsh": "NSIS",
    ".nsi": "NSIS",
    ".objdump-intel": "objdump-nasm",
    ".n": "Nemerle",
    ".nt": "NestedText",
    ".kif": "NewLisp",
    ".lsp": "NewLisp",
    ".nl": "NewLisp",
    ".ns2": "Newspeak",
    ".nim": "Nimrod",
    ".nimrod": "Nimrod",
    ".nit": "Nit",
    ".nix": "Nix",
    ".smv": "NuSMV",
    ".numba_ir": "Numba_IR",
    ".objdump": "objdump",
    ".j": "Objective-J",
    ".ml": "OCaml",
    ".mli": "OCaml",
    ".mll": "OCaml",
    ".mly": "OCaml",
    ".odin": "ODIN",
    ".ooc": "Ooc",
    ".opa": "Opa",
    ".cls": "OpenEdge ABL",
    ".scad": "OpenSCAD",
    ".org": "Org Mode",
    ".pan": "Pan",
    ".psi": "ParaSail",
    ".psl": "ParaSail",
    ".p": "Pawn",
    ".pwn": "Pawn",
    ".pddl": "PDDL",
    ".peg": "PEG",
    ".6pl": "Perl6",
    ".6pm": "Perl6",
    ".nqp": "Perl6",
    ".p6": "Perl6",
    ".p6l": "Perl6",
    ".p6m": "Perl6",
    ".pl6": "Perl6",
    ".pm6": "Perl6",
    ".raku": "Perl6",
    ".rakudoc": "Perl6",
    ".rakumod": "Perl6",
    ".rakutest": "Perl6",
    ".perl": "Perl",
    ".exw": "Phix",
    ".php": "PHP",
    ".php3": "PHP",
    ".php4": "PHP",
    ".php5": "PHP",
    ".pig": "Pig",
    ".pc": "PkgConfig",
    ".ptls": "Pointless",
    ".pony": "Pony",
    ".alg": "Portugol",
    ".portugol": "Portugol",
    ".eps": "PostScript",
    ".ps": "PostScript",
    ".explain": "PostgreSQL EXPLAIN dialect",
    ".inc": "POVRay",
    ".pov": "POVRay",
    ".ps1": "PowerShell",
    ".psm1": "PowerShell",
    ".praat": "Praat",
    ".proc": "Praat",
    ".psc": "Praat",
    ".ecl": "Prolog",
    ".pl": "Prolog",
    ".prolog": "Prolog",
    ".promql": "PromQL",
    ".properties": "Properties",
    ".proto": "Protocol Buffer",
    ".prql": "PRQL",
    ".ptx": "PTX",
    ".jade": "Pug",
    ".pug": "Pug",
    ".pp": "Puppet",
    ".purs": "PureScript",
    ".pypylog": "PyPy Log",
    ".py2tb": "Python 2.x Traceback",
    ".bzl": "Python",
    ".jy": "Python",
    ".py": "Python",
    ".pye": "Python",
    ".pyi": "Python",
    ".pyw": "Python",
    ".sage": "Python",
    ".tac": "Python",
    ".py3tb": "Python Traceback",
    ".pytb": "Python Traceback",
    ".pyul4": "Python+UL4",
    ".BAS": "QBasic",
    ".q": "Q",
    ".qvto": "QVTO",
    ".qvs": "Qlik",
    ".qvw": "Qlik",
    ".qbs": "QML",
    ".qml": "QML",
    ".Rout": "RConsole",
    ".rnc": "Relax-NG Compact",
    ".spec": "RPMSpec",
    ".rkt": "Racket",
    ".rktd": "Racket",
    ".rktl": "Racket",
    ".rl": "Ragel in Ruby Host",
    ".Rd": "Rd",
    ".re": "ReasonML",
    ".rei": "ReasonML",
    ".r": "REBOL",
    ".r3": "REBOL",
    ".reb": "REBOL",
    ".red": "Red",
    ".reds": "Red",
    ".cw": "Redcode",
    ".reg": "reg",
    ".rego": "Rego",
    ".rell": "Rell",
    ".arexx": "Rexx",
    ".rex": "Rexx",
    ".rexx": "Rexx",
    ".rx": "Rexx",
    ".rhtml": "RHTML",
    ".ride": "Ride",
    ".rita": "Rita",
    ".graph": "Roboconf Graph",
    ".instances": "Roboconf Instances",
    ".resource": "RobotFramework",
    ".robot": "RobotFramework",
    ".rql": "RQL",
    ".rsl": "RSL",
    ".rest": "reStructuredText",
    ".rst": "reStructuredText",
    ".rts": "TrafficScript",
    ".duby": "Ruby",
    ".gemspec": "Ruby",
    ".rake": "Ruby",
    ".rb": "Ruby",
    ".rbw": "Ruby",
    ".rbx": "Ruby",
    ".rs": "Rust",
    ".rs.in": "Rust",
    ".SAS": "SAS",
    ".sas": "SAS",
    ".R": "S",
    ".S": "S",
    ".fun": "Standard ML",
    ".sig": "Standard ML",
    ".sml": "Standard ML",
    ".snbt": "SNBT",
    ".sarl": "SARL",
    ".sass": "Sass",
    ".savi": "Savi",
    ".scala": "Scala",
    ".scaml": "Scaml",
    ".scdoc": "scdoc",
    ".scm": "Scheme",
    ".ss": "Scheme",
    ".sce": "Scilab",
    ".sci": "Scilab",
    ".tst": "Scilab",
    ".scss": "SCSS",
    ".gsed": "Sed",
    ".sed": "Sed",
    ".ssed": "Sed",
    ".shex": "ShExC",
    ".shen": "Shen",
    ".sieve": "Sieve",
    ".siv": "Sieve",
    ".sil": "Silver",
    ".vpr": "Silver",
    ".def": "Singularity",
    ".sla": "Slash",
    ".slim": "Slim",
    ".sl": "Slurm",
    ".smali": "Smali",
    ".st": "Smalltalk",
    ".sgf": "SmartGameFormat",
    ".tpl": "Smarty",
    ".smithy": "Smithy",
    ".snobol": "Snobol",
    ".sbl": "Snowball",
    ".sol": "Solidity",
    ".aes": "Sophia",
    ".sp": "SourcePawn",
    ".rq": "SPARQL",
    ".sparql": "SPARQL",
    ".spice": "Spice",
    ".sql.j2": "SQL+Jinja",
    ".sql.jinja2": "SQL+Jinja",
    ".sqlite3-console": "sqlite3con",
    ".ssp": "Scalate Server Page",
    ".stan": "Stan",
    ".ado": "Stata",
    ".do": "Stata",
    ".sc": "SuperCollider",
    ".scd": "SuperCollider",
    ".swift": "Swift",
    ".sv": "systemverilog",
    ".svh": "systemverilog",
    ".automount": "Systemd",
    ".device": "Systemd",
    ".mount": "Systemd",
    ".path": "Systemd",
    ".scope": "Systemd",
    ".service": "Systemd",
    ".slice": "Systemd",
    ".socket": "Systemd",
    ".swap": "Systemd",
    ".target": "Systemd",
    ".timer": "Systemd",
    ".tap": "TAP",
    ".tnt": "Typographic Number Theory",
    ".toml": "TOML",
    ".td": "TableGen",
    ".tact": "Tact",
    ".t": "TADS 3",
    ".tal": "Tal",
    ".tasm": "TASM",
    ".rvt": "Tcl",
    ".tcl": "Tcl",
    ".csh": "Tcsh",
    ".tcsh": "Tcsh",
    ".tea": "Tea",
    ".teal": "teal",
    ".hcl": "Terraform",
    ".tf": "Terraform",
    ".aux": "TeX",
    ".tex": "TeX",
    ".ti": "ThingsDB",
    ".thrift": "Thrift",
    ".tid": "tiddler",
    ".tlb": "Tl-b",
    ".todotxt": "Todotxt",
    ".sql": "Transact-SQL",
    ".treetop": "Treetop",
    ".tt": "Treetop",
    ".ttl": "Turtle",
    ".twig": "HTML+Twig",
    ".typoscript": "TypoScript",
    ".typ": "Typst",
    ".ul4": "UL4",
    ".u1": "ucode",
    ".u2": "ucode",
    ".icn": "Unicon",
    ".u": "UrbiScript",
    ".usd": "USD",
    ".usda": "USD",
    ".VBS": "VBScript",
    ".vbs": "VBScript",
    ".vcl": "VCL",
    ".rpf": "VGL",
    ".vala": "Vala",
    ".vapi": "Vala",
    ".asax": "aspx-vb",
    ".ascx": "aspx-vb",
    ".ashx": "aspx-vb",
    ".asmx": "aspx-vb",
    ".aspx": "aspx-vb",
    ".axd": "aspx-vb",
    ".bas": "VB.net",
    ".vb": "VB.net",
    ".fhtml": "Velocity",
    ".vm": "Velocity",
    ".vp": "Verifpal",
    ".v": "verilog",
    ".vhd": "vhdl",
    ".vhdl": "vhdl",
    ".vim": "VimL",
    ".vipgrm": "Visual Prolog Grammar",
    ".cl": "Visual Prolog",
    ".pack": "Visual Prolog",
    ".ph": "Visual Prolog",
    ".pro": "Visual Prolog",
    ".vue": "Vue",
    ".vy": "Vyper",
    ".wdiff": "WDiff",
    ".wast": "WebAssembly",
    ".wat": "WebAssembly",
    ".webidl": "Web IDL",
    ".wgsl": "WebGPU Shading Language",
    ".whiley": "Whiley",
    ".toc": "World of Warcraft TOC",
    ".wren": "Wren",
    ".x10": "X10",
    ".xmlul4": "XML+UL4",
    ".xq": "XQuery",
    ".xql": "XQuery",
    ".xqm": "XQuery",
    ".xquery": "XQuery",
    ".xqy": "XQuery",
    ".xml.j2": "XML+Django/Jinja",
    ".xml.jinja2": "XML+Django/Jinja",
    ".pom": "XML",
    ".rss": "XML",
    ".svg": "XML",
    ".wsdl": "XML",
    ".wsf": "XML",
    ".xbrl": "XML",
    ".xml": "XML",
    ".xsd": "XML",
    ".xpp": "X++",
    ".xpl": "XSLT",
    ".xsl": "XSLT",
    ".xslt": "XSLT",
    ".xtend": "Xtend",
    ".xtm": "xtlang",
    ".sls": "YAML+Jinja",
    ".yaml.j2": "YAML+Jinja",
    ".yaml.jinja2": "YAML+Jinja",
    ".yml.j2": "YAML+Jinja",
    ".yml.jinja2": "YAML+Jinja",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".yang": "YANG",
    ".yar": "YARA",
    ".bro": "Zeek",
    ".zeek": "Zeek",
    ".zep": "Zephir",
    ".zig": "Zig",
    ".ans": "ANSYS parametric design language",
    ".txt": "Text only",
    ".i": "SWIG",
    ".swg": "SWIG",
    ".m": "Objective-C",
    ".mm": "Objective-C++",
    ".ino": "Arduino",
    ".c": "C",
    ".h": "C",
    ".idc": "C",
    ".xbm": "C",
    ".xpm": "C",
    ".ci": "Charmci",
    ".C": "C++",
    ".CPP": "C++",
    ".H": "C++",
    ".c++": "C++",
    ".cc": "C++",
    ".cp": "C++",
    ".cpp": "C++",
    ".cppm": "C++",
    ".cxx": "C++",
    ".h++": "C++",
    ".hh": "C++",
    ".hpp": "C++",
    ".hxx": "C++",
    ".ipp": "C++",
    ".ixx": "C++",
    ".mxx": "C++",
    ".tpp": "C++",
    ".cu": "CUDA",
    ".cuh": "CUDA",
    ".ec": "eC",
    ".eh": "eC",
    ".edp": "Freefem",
    ".mq4": "MQL",
    ".mq5": "MQL",
    ".mqh": "MQL",
    ".nc": "nesC",
    ".idl": "OMG Interface Definition Language",
    ".pidl": "OMG Interface Definition Language",
    ".pike": "Pike",
    ".pmod": "Pike",
    ".pm": "Promela",
    ".pml": "Promela",
    ".pr": "Promela",
    ".prm": "Promela",
    ".prom": "Promela",
    ".promela": "Promela",
    ".x": "Logos",
    ".xi": "Logos",
    ".xm": "Logos",
    ".xmi": "Logos",
    ".tsx": "TSX",
    ".ts": "TypeScript",
    ".ASM": "NASM",
    ".asm": "NASM",
    ".nasm": "NASM",
}
