"""Language table: how each language is masked, where its blocks begin, how its signatures read.

Adding a language means adding a row: build a ``LanguageSpec`` and pass it along with ``DEFAULT_LANGUAGES``.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import suffix


@dataclass(frozen=True)
class LanguageSpec:
    name: str
    suffixes: tuple[str, ...]
    layout: str  # indent, braces or statements
    tokens: str  # alternation that cuts a text into strings, comments and the rest
    string_lead: str  # what a string token starts with
    comment_lead: str  # what a comment token starts with
    header: str = ""  # where a block starts; @CALL@ stands for "a parameter list follows"
    member: str = ""  # header form valid only directly inside a class
    class_word: str = r"\bclass\s"
    function_word: str = r"\bfunction\s+&?\s*[^\s(]"
    functions_in_class_are_methods: bool = False
    bodiless_functions: bool = False
    name_after: str = ""
    brackets: str = r"[()\[\]{}]"
    output: str = ""
    split_outputs_on: str = ""
    bases: str = ""


# fixed values: lexical forms of the languages that have a handler
PYTHON = LanguageSpec(
    name="python",
    suffixes=(".py",),
    layout="indent",
    tokens=r'("""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
    r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"""|#[^\n]*+|[^"'#]++|["'])""",
    string_lead=r"""^["'][\s\S]""",
    comment_lead=r"^#",
    header=r"^\s*(?:(?:async\s+)?def|class)\s+[^\s(:\[]",
    name_after=r"^(?:async\s+)?(?:def|class)\s+([^\s(:\[]+)",
    output=r"^\s*->\s*([\s\S]*?)\s*:\s*$",
)

_C_STRINGS = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"

PHP = LanguageSpec(
    name="php",
    suffixes=(".php",),
    layout="braces",
    tokens="(" + _C_STRINGS + r"""|<<<[ \t]*+["']?(\w++)["']?[ \t\r]*+\n(?:[\s\S]*?\n)??[ \t]*+\2\b"""
    r"""|/\*[\s\S]*?\*/|//[^\n]*+|#[^\n]*+|[^"'#/<]++|["'#/<])""",
    string_lead=r"""^(?:["'][\s\S]|<<<)""",
    comment_lead=r"^(?:#|//|/\*)",
    header=r"(?<![\w$:>\\])(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*+"
    r"(?:function\s+&?\s*[^\s(&]+@CALL@|(?:class|interface|trait|enum)\s+(?!extends\b|implements\b)\w+)",
    functions_in_class_are_methods=True,
    bodiless_functions=True,
    name_after=r"\b(?:function\s+&?\s*|class\s+)([^\s({]+)",
    output=r"^\s*:\s*([\s\S]*?)\s*[{;]?\s*$",
    split_outputs_on=r"\s*\|\s*",
    bases=r"\bextends\s+\\?(?:\w+\\)*(\w+)",
)

TYPESCRIPT = LanguageSpec(
    name="typescript",
    suffixes=(".ts", ".tsx"),
    layout="braces",
    tokens=r'("[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    # a template with templates in its slots, or a plain one
    r"|`[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{)|\$\{(?:[^`{}]++|`[^`]*+`|\{[^{}]*+\})*+\})[^`\\$]*+)*+`"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|/\*[\s\S]*?\*/|//[^\n]*+"
    # a regular expression: a slash where a value may begin
    r"|(?<=(?:[(,=:\[!&|?{;+\-*%~^\n]|\breturn|\btypeof|\bcase)[ \t]{0,20})"
    r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
    r"""|[^"'`/]++|["'`/])""",
    string_lead=r"""^(?:["'`][\s\S]|/[^/*])""",
    comment_lead=r"^(?://|/\*)",
    header=r"(?<![\w$.])(?<![=(,:?&|]\s{0,20})(?<!\b(?:return|async)\s{1,20})"
    r"(?:(?:async\s+)?function\s+[\w$]+@CALL@|(?:abstract\s+)?class\s+(?!extends\b|implements\b)[\w$]+)",
    member=r"(?:^|(?<=[{};])|(?<=\n))[ \t\n]*+(?:(?:public|protected|private|static|override|abstract|readonly|async|get|set)\s+)*+"
    r"\*?\s*[#\w$]+@CALL@",
    class_word=r"^class\s",
    functions_in_class_are_methods=True,
    name_after=r"^(?:(?:async\s+)?function\s+|class\s+|(?:(?:public|protected|private|static|override|abstract|readonly|async|get|set)\s+)*+\*?\s*)([#\w$]+)",
    brackets=r"[()\[\]{}<>]",
    output=r"^\s*:\s*([\s\S]*?)\s*[{;]?\s*$",
    bases=r"\bextends\s+([A-Za-z_$][\w$]*)",
)

SQL = LanguageSpec(
    name="sql",
    suffixes=(".sql",),
    layout="statements",
    tokens=r"""('[^']*+'|"[^"]*+"|--[^\n]*+|/\*[\s\S]*?\*/|\$(\w*)\$[\s\S]*?\$\2\$|[^'"\-/$]++|['"\-/$])""",
    string_lead=r"""^(?:["'][\s\S]|\$\w*\$)""",
    comment_lead=r"^(?:--|/\*)",
)

DEFAULT_LANGUAGES = (PYTHON, PHP, TYPESCRIPT, SQL)


def language_specs(spark: SparkSession, languages=DEFAULT_LANGUAGES) -> DataFrame:
    """C14: the language table as rows (language, suffix, layout, header, member, bases)."""
    rows = [
        (spec.name, ending, spec.layout, spec.header, spec.member, spec.bases)
        for spec in languages
        for ending in spec.suffixes
    ]
    return spark.createDataFrame(
        rows, "language string, suffix string, layout string, header string, member string, bases string"
    )


def language_of(path: Column, languages=DEFAULT_LANGUAGES) -> Column:
    """Language whose exact suffix the path carries, NULL when none has a handler."""
    ending = suffix(path)
    out = F.lit(None).cast("string")
    for spec in languages:
        out = F.when(ending.isin(*spec.suffixes), F.lit(spec.name)).otherwise(out)
    return out
