"""Code files to code blocks.

A file is one row and its blocks depend on nothing else, so the cut is a column expression: no shuffle, no
Python worker. Text is masked (strings and comments lose their content but keep their length), one ordered fold
with a stack of open blocks finds the extents, and the blocks are built from the extents.
"""

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.folds import append_if, collecting_fold, record
from corpusloom.functions.rows import explode_once
from corpusloom.functions.text import bind, null_if_empty, python_tuple, strip_space
from corpusloom.operators.languages import DEFAULT_LANGUAGES, LanguageSpec, language_of
from corpusloom.schemas import BLOCK

FILLER = "\u0001"  # stands for a sign inside a string

_EXTENT = (
    "struct<start:int,stop:int,start_line:int,end_line:int,col:int,kind:string,level:int,parens:int,body:int,"
    "owner_start:int,owner_kind:string,class_start:int>"
)
_EXTENTS = f"array<{_EXTENT}>"
_CUTS = "struct<pos:int,depth:int,cuts:array<int>,closed:boolean>"


def mask(text: Column, spec: LanguageSpec) -> Column:
    """Same length and line breaks; comment signs become blanks, signs inside strings become a filler."""

    def hide(token: Column) -> Column:
        hidden = F.regexp_replace(token, r"(?<!^)[^\n]", FILLER)
        return (
            F.when(token.rlike(spec.comment_lead), F.regexp_replace(token, r"[^\n]", " "))
            .when(token.rlike(spec.string_lead), hidden)
            .otherwise(token)
        )

    pieces = F.regexp_extract_all(text, F.lit(spec.tokens), F.lit(1))
    return F.array_join(F.transform(pieces, hide), "")


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _breaks(text: Column) -> Column:
    """Number of line breaks; most texts asked have none, and no pattern is matched for them."""
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.contains(text, F.lit("\n")), count).otherwise(F.lit(0))


def _extent(start, stop, start_line, end_line, col, kind, level, parens, body, owner) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        stop.cast("int").alias("stop"),
        start_line.cast("int").alias("start_line"),
        end_line.cast("int").alias("end_line"),
        col.cast("int").alias("col"),
        kind.alias("kind"),
        level.cast("int").alias("level"),
        parens.cast("int").alias("parens"),
        body.cast("int").alias("body"),
        F.coalesce(owner["start"], F.lit(-1)).alias("owner_start"),
        F.coalesce(owner["kind"], F.lit("")).alias("owner_kind"),
        F.when(owner["kind"] == "class", owner["start"])
        .otherwise(F.coalesce(owner["class_start"], F.lit(-1)))
        .alias("class_start"),
    )


def _close(item: Column, stop: Column, line: Column) -> Column:
    order = [part.split(":")[0] for part in _EXTENT[7:-1].split(",")]
    return record(item, order, stop=stop.cast("int"), end_line=line.cast("int"))


def _with_body(item: Column, body: Column) -> Column:
    order = [part.split(":")[0] for part in _EXTENT[7:-1].split(",")]
    return record(item, order, body=body.cast("int"))


def _indent_extents(masked: Column, spec: LanguageSpec) -> Column:
    """Blocks that end before the next statement indented no deeper than their header."""
    order = ["pos", "line", "depth", "joined", "stop", "end_line", "open", "done"]
    zero = {
        "pos": F.lit(0),
        "line": F.lit(0),
        "depth": F.lit(0),
        "joined": F.lit(False),
        "stop": F.lit(0),
        "end_line": F.lit(0),
        "open": F.array().cast(_EXTENTS),
    }

    def step(acc: Column, text: Column) -> Column:
        following = {"pos": acc["pos"] + F.length(text) + 1, "line": acc["line"] + 1}
        blank = record(acc, order, **following)
        return F.when(text.rlike(r"^\s*$"), blank).otherwise(
            bind(
                F.struct(
                    F.when(
                        text.rlike(r"[()\[\]{}]"),
                        acc["depth"] + _count(text, r"[(\[{]") - _count(text, r"[)\]}]"),
                    )
                    .otherwise(acc["depth"])
                    .alias("depth"),
                    (acc["pos"] + F.length(F.regexp_replace(text, r"\s+$", ""))).alias("stop"),
                    F.length(F.regexp_extract(text, r"^\s*", 0)).alias("indent"),
                    text.rlike(r"\\\s*$").alias("joined"),
                ),
                lambda now: F.when(
                    (acc["depth"] > 0) | acc["joined"] | text.startswith(FILLER),
                    record(
                        acc,
                        order,
                        **following,
                        depth=now["depth"],
                        joined=now["joined"],
                        stop=now["stop"],
                        end_line=acc["line"],
                        open=F.when(
                            (now["depth"] == 0) & ~now["joined"],
                            F.transform(
                                acc["open"],
                                lambda o: F.when(o["body"] < 0, _with_body(o, now["stop"])).otherwise(o),
                            ),
                        ).otherwise(acc["open"]),
                    ),
                ).otherwise(
                    bind(
                        F.filter(acc["open"], lambda o: o["level"] < now["indent"]),
                        lambda kept: record(
                            acc,
                            order,
                            **following,
                            depth=now["depth"],
                            joined=now["joined"],
                            stop=now["stop"],
                            end_line=acc["line"],
                            open=F.when(
                                text.rlike(spec.header),
                                F.concat(
                                    kept,
                                    F.array(
                                        _extent(
                                            acc["pos"] + now["indent"],
                                            F.lit(-1),
                                            acc["line"],
                                            F.lit(-1),
                                            now["indent"],
                                            F.when(text.rlike(r"^\s*class\b"), F.lit("class")).otherwise(
                                                F.lit("function")
                                            ),
                                            now["indent"],
                                            F.lit(0),
                                            F.when(
                                                (now["depth"] == 0) & ~now["joined"], now["stop"]
                                            ).otherwise(F.lit(-1)),
                                            _last(kept),
                                        )
                                    ),
                                ),
                            ).otherwise(kept),
                            **append_if(
                                F.size(kept) < F.size(acc["open"]),
                                acc,
                                F.transform(
                                    F.filter(acc["open"], lambda o: o["level"] >= now["indent"]),
                                    lambda o: _close(o, acc["stop"], acc["end_line"]),
                                ),
                            ),
                        ),
                    )
                ),
            )
        )

    def finish(acc: Column, done: Column) -> Column:
        return F.concat(done, F.transform(acc["open"], lambda o: _close(o, acc["stop"], acc["end_line"])))

    lines = F.split(masked, "\n")
    return bind(lines, lambda t: F.sort_array(collecting_fold(t, zero, _EXTENTS, step, finish)))


def _brace_extents(masked: Column, spec: LanguageSpec) -> Column:
    """Blocks that run from their header to the brace that closes the one after it."""
    form = f"(?:{spec.header}" + (f"|{spec.member})" if spec.member else ")")
    header = form.replace("@CALL@", "")
    ahead = form.replace("@CALL@", r"(?=\s*(?:<[^(){};]*>)?\s*\()")
    events = F.regexp_extract_all(masked, F.lit(rf"[\s\S]*?(?:{ahead}|[{{}}();]|\z)"), F.lit(0))
    order = ["pos", "line", "line_pos", "depth", "parens", "open", "done"]
    zero = {n: F.lit(0) for n in ("pos", "line", "line_pos", "depth", "parens")}
    zero["open"] = F.array().cast(_EXTENTS)

    def without_pending(open_: Column) -> Column:
        return F.filter(open_, lambda o: o["body"] >= 0)

    def step(acc: Column, text: Column) -> Column:
        sign = F.right(text, F.lit(1))
        pos = acc["pos"] + F.length(text)
        line = acc["line"] + _breaks(text)
        line_pos = F.when(F.contains(text, F.lit("\n")), pos - F.length(F.substring_index(text, "\n", -1))).otherwise(
            acc["line_pos"]
        )
        moved = {"pos": pos, "line": line, "line_pos": line_pos}
        top = _last(acc["open"])
        waiting = (top["body"] < 0) & (top["parens"] == acc["parens"])

        opened = record(
            acc,
            order,
            **moved,
            depth=acc["depth"] + 1,
            open=F.when(
                waiting & ~text.rlike(r"[:|&=<,]\s*\{$"),
                F.transform(acc["open"], lambda o: F.when(o["body"] < 0, _with_body(o, pos)).otherwise(o)),
            ).otherwise(acc["open"]),
        )

        def closing(acc_open: Column) -> Column:
            ends = (_last(acc_open)["body"] >= 0) & (_last(acc_open)["level"] >= acc["depth"] - 1)
            return record(
                acc,
                order,
                **moved,
                depth=F.greatest(acc["depth"] - 1, F.lit(0)),
                parens=F.when(ends, _last(acc_open)["parens"]).otherwise(acc["parens"]),
                open=F.when(ends, F.slice(acc_open, F.lit(1), F.size(acc_open) - 1)).otherwise(acc_open),
                **append_if(ends, acc, F.array(_close(_last(acc_open), pos, line))),
            )

        still_open = F.filter(acc["open"], lambda o: (o["body"] >= 0) | (o["level"] < acc["depth"]))
        closed = bind(still_open, closing)

        keeps_declaration = F.lit(spec.bodiless_functions) & top["kind"].isin("function", "method")
        ended = F.when(
            waiting,
            record(
                acc,
                order,
                **moved,
                open=without_pending(acc["open"]),
                **append_if(keeps_declaration, acc, F.array(_close(top, pos, line))),
            ),
        ).otherwise(record(acc, order, **moved))

        def begin(found: Column) -> Column:
            def push(open_: Column) -> Column:
                owner = _last(open_)
                in_class = (
                    owner["kind"].isin("class", "holder")
                    & (owner["level"] == acc["depth"] - 1)
                    & (owner["parens"] == acc["parens"])
                )
                is_function = found.rlike(spec.function_word)
                is_class = found.rlike(spec.class_word)
                is_holder = found.rlike(r"\b(?:class|interface|trait|enum)\s+[\w$]+$")
                inside = F.coalesce(in_class, F.lit(False))
                kind = (
                    F.when(is_class, F.lit("class"))
                    .when(is_holder, F.lit("holder"))
                    .when(
                        is_function,
                        F.when(inside & F.lit(spec.functions_in_class_are_methods), F.lit("method")).otherwise(
                            F.lit("function")
                        ),
                    )
                    .when(inside, F.lit("method"))
                )
                # a header over several lines starts in the line it began in, so its column is counted from there
                breaks = _breaks(found)
                before = F.substr(text, F.lit(1), F.length(text) - F.length(found))
                col = F.when(breaks == 0, pos - F.length(found) - line_pos).otherwise(
                    F.when(
                        F.contains(before, F.lit("\n")), F.length(F.substring_index(before, "\n", -1))
                    ).otherwise(acc["pos"] + F.length(before) - acc["line_pos"])
                )
                extent = _extent(
                    pos - F.length(found),
                    F.lit(-1),
                    line - breaks,
                    F.lit(-1),
                    col,
                    kind,
                    acc["depth"],
                    acc["parens"],
                    F.lit(-1),
                    owner,
                )
                return F.when(
                    kind.isNotNull(), record(acc, order, **moved, open=F.concat(open_, F.array(extent)))
                ).otherwise(record(acc, order, **moved))

            return bind(without_pending(acc["open"]), push)

        return (
            F.when(sign == "{", opened)
            .when(sign == "}", closed)
            .when(sign == "(", record(acc, order, **moved, parens=acc["parens"] + 1))
            .when(sign == ")", record(acc, order, **moved, parens=F.greatest(acc["parens"] - 1, F.lit(0))))
            .when(sign == ";", ended)
            .when(
                sign.rlike(r"[\w$]"),
                bind(
                    F.regexp_replace(F.regexp_extract(text, f"({header})$", 1), r"^\s+", ""),
                    lambda found: F.when(found != "", begin(found)).otherwise(record(acc, order, **moved)),
                ),
            )
            .otherwise(record(acc, order, **moved))
        )

    return bind(
        events, lambda e: F.sort_array(collecting_fold(e, zero, _EXTENTS, step, lambda _, done: done))
    )


def _signature_cuts(signature: Column, spec: LanguageSpec) -> Column:
    """Offsets of the opening parenthesis, the commas directly inside it, and the closing one."""
    pieces = F.regexp_extract_all(
        signature, F.lit(rf"=>|->|{spec.brackets}|,|[^()\[\]{{}}<>,=\-]+|[\s\S]"), F.lit(0)
    )
    zero = F.struct(
        F.lit(0).alias("pos"),
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("cuts"),
        F.lit(False).alias("closed"),
    )
    opening = "([{<" if "<" in spec.brackets else "([{"
    shutting = ")]}>" if ">" in spec.brackets else ")]}"
    order = ["pos", "depth", "cuts", "closed"]

    def step(acc: Column, piece: Column) -> Column:
        moved = acc["pos"] + F.length(piece)
        cut = F.concat(acc["cuts"], F.array(acc["pos"]))
        inner = (F.size(acc["cuts"]) > 0) & (acc["depth"] == 1)
        opened = record(
            acc,
            order,
            pos=moved,
            depth=acc["depth"] + 1,
            cuts=F.when((piece == "(") & (acc["depth"] == 0) & (F.size(acc["cuts"]) == 0), cut).otherwise(acc["cuts"]),
        )
        shut = F.when(
            inner, record(acc, order, pos=moved, depth=acc["depth"] - 1, cuts=cut, closed=F.lit(True))
        ).otherwise(record(acc, order, pos=moved, depth=acc["depth"] - 1))
        # nothing behind the closing parenthesis makes a cut
        return (
            F.when(acc["closed"], acc)
            .when(piece.isin(*opening), opened)
            .when(piece.isin(*shutting), shut)
            .when((piece == ",") & inner, record(acc, order, pos=moved, cuts=cut))
            .otherwise(record(acc, order, pos=moved))
        )

    return F.aggregate(pieces, zero, step, lambda acc: acc["cuts"])


def _argument_texts(signature: Column, cuts: Column) -> Column:
    pairs = F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1)))
    texts = F.transform(
        F.filter(pairs, lambda i: i < F.size(cuts)),
        lambda i: strip_space(
            F.substr(signature, F.get(cuts, i - 1) + 2, F.get(cuts, i) - F.get(cuts, i - 1) - 1)
        ),
    )
    return F.filter(texts, lambda t: t != "")


def _lines_of(lines: Column, item: Column) -> Column:
    """Text of the lines an extent covers, from its first column on; the rest of the file is not touched."""
    covered = F.slice(lines, item["start_line"] + 1, item["end_line"] - item["start_line"] + 1)
    return F.substr(F.array_join(covered, "\n"), item["col"] + 1, F.lit(2147483647))


def _describe(raw_lines: Column, masked_lines: Column, item: Column, spec: LanguageSpec) -> Column:
    """Name, code, inputs, outputs and bases of one extent."""
    head_length = F.when(item["body"] >= 0, item["body"]).otherwise(item["stop"]) - item["start"]

    def from_signature(sig: Column) -> Column:
        return bind(
            F.struct(
                sig.alias("sig"),
                _signature_cuts(sig["masked"], spec).alias("cuts"),
            ),
            lambda s: bind(
                F.struct(
                    _argument_texts(s["sig"]["raw"], s["cuts"]).alias("args"),
                    F.substr(
                        s["sig"]["raw"], F.coalesce(_last(s["cuts"]), F.lit(0)) + 2, F.lit(2147483647)
                    ).alias("rest"),
                ),
                lambda p: F.struct(
                    item.alias("at"),
                    s["sig"]["code"].alias("code"),
                    F.regexp_extract(s["sig"]["masked"], spec.name_after, 1).alias("name"),
                    (item["kind"] == "class").alias("is_class"),
                    F.when(item["kind"] == "class", _first_base(s["sig"], p["args"], spec))
                    .otherwise(null_if_empty(p["args"]))
                    .alias("inputs"),
                    F.when(item["kind"] != "class", _outputs(p["rest"], spec)).alias("outputs"),
                    F.when(item["kind"] == "class", _all_bases(s["sig"], p["args"], spec)).alias("all_bases"),
                ),
            ),
        )

    code = F.substr(_lines_of(raw_lines, item), F.lit(1), item["stop"] - item["start"])
    return bind(
        code,
        lambda text: bind(
            F.struct(
                text.alias("code"),
                F.substr(_lines_of(masked_lines, item), F.lit(1), head_length).alias("masked"),
                F.substr(text, F.lit(1), head_length).alias("raw"),
            ),
            from_signature,
        ),
    )


def _first_base(sig: Column, args: Column, spec: LanguageSpec) -> Column:
    """First plain identifier among the bases; failing that, the first identifier of the first base."""
    if spec.bases:
        found = F.regexp_extract(sig["masked"], spec.bases, 1)
        return F.when(found != "", F.array(found))
    plain = F.get(F.filter(args, lambda a: a.rlike(r"^[A-Za-z_]\w*$")), F.lit(0))
    leading = F.regexp_extract(F.coalesce(F.get(args, F.lit(0)), F.lit("")), r"([A-Za-z_]\w*)", 1)
    found = F.coalesce(plain, leading)
    return F.when(found != "", F.array(found))


def _all_bases(sig: Column, args: Column, spec: LanguageSpec) -> Column:
    if spec.bases:
        found = F.regexp_extract(sig["masked"], spec.bases, 1)
        return F.when(found != "", F.array(found))
    named = F.filter(args, lambda a: ~a.rlike(r"^\w+\s*=") & ~a.startswith("*"))
    return null_if_empty(
        F.filter(
            F.transform(named, lambda a: F.regexp_extract(a, r"^(?:\w+\.)*(\w+)", 1)), lambda b: b != ""
        )
    )


def _outputs(rest: Column, spec: LanguageSpec) -> Column:
    found = F.regexp_extract(rest, spec.output, 1)
    parts = F.split(found, spec.split_outputs_on) if spec.split_outputs_on else F.array(found)
    return F.when(found != "", parts)


def _class_summary(cls: Column, methods: Column) -> Column:
    head = F.concat(
        F.lit("class: "), cls["name"], F.lit("\n    parent classes: "), python_tuple(cls["inputs"]), F.lit("\n")
    )
    described = F.transform(
        methods,
        lambda m: F.concat(
            F.lit("    method: "),
            m["name"],
            F.lit("\n        input parameters: "),
            python_tuple(m["inputs"]),
            F.lit("\n        output parameters: "),
            python_tuple(m["outputs"]),
            F.lit("\n        code: ...\n"),
        ),
    )
    return F.array_join(F.concat(F.array(head), described), "\n")


def _block(**values) -> Column:
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK.fields]
    )


def _uncovered(lines: Column, extents: Column) -> Column:
    """Lines outside every extent, joined; NULL when only blanks are left."""
    gaps = collecting_fold(
        extents,
        {"next": F.lit(0)},
        "array<struct<first:int,past:int>>",
        lambda acc, e: record(
            acc,
            ["next", "done"],
            next=F.greatest(acc["next"], e["end_line"] + 1),
            **append_if(
                e["start_line"] > acc["next"],
                acc,
                F.array(F.struct(acc["next"].alias("first"), e["start_line"].alias("past"))),
            ),
        ),
        lambda acc, done: F.concat(
            done,
            F.array(
                F.struct(acc["next"].alias("first"), F.greatest(F.size(lines), acc["next"]).alias("past"))
            ),
        ),
    )
    text = F.array_join(
        F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["first"] + 1, g["past"] - g["first"]))), "\n"
    )
    return bind(text, lambda t: F.when(~t.rlike(r"^\s*$"), F.regexp_replace(t, r"^(?:[ \t]*\n)+", "")))


def _structured_blocks(text: Column, spec: LanguageSpec) -> Column:
    extents_of = _indent_extents if spec.layout == "indent" else _brace_extents

    def from_mask(src: Column) -> Column:
        return bind(
            F.struct(
                src.alias("src"),
                F.filter(extents_of(src["masked"], spec), lambda e: e["kind"] != "holder").alias("extents"),
            ),
            lambda s: bind(
                F.struct(
                    s.alias("s"),
                    F.transform(
                        s["extents"],
                        lambda e: _describe(s["src"]["raw_lines"], s["src"]["masked_lines"], e, spec),
                    ).alias("items"),
                ),
                with_classes,
            ),
        )

    def with_classes(known: Column) -> Column:
        classes = F.filter(known["items"], lambda i: i["is_class"])
        return bind(
            classes,
            lambda found: bind(
                F.struct(
                    known["s"].alias("s"),
                    known["items"].alias("items"),
                    F.map_from_arrays(
                        F.transform(found, lambda c: c["at"]["start"]), F.transform(found, lambda c: c["name"])
                    ).alias("class_names"),
                ),
                build,
            ),
        )

    def build(known: Column) -> Column:
        items = known["items"]

        def of_kind(kind: str) -> Column:
            return F.filter(items, lambda i: i["at"]["kind"] == kind)

        def class_block(item: Column) -> Column:
            methods = F.filter(
                items, lambda m: ~m["is_class"] & (m["at"]["owner_start"] == item["at"]["start"])
            )
            return _block(
                code_type=F.lit("class"),
                class_name=item["name"],
                code=item["code"],
                summary=_class_summary(item, methods),
                inputs=item["inputs"],
                start_line=item["at"]["start_line"],
                end_line=item["at"]["end_line"],
                all_bases=item["all_bases"],
            )

        def function_block(item: Column) -> Column:
            return _block(
                code_type=F.lit("function"),
                function_name=item["name"],
                code=item["code"],
                inputs=item["inputs"],
                outputs=item["outputs"],
                start_line=item["at"]["start_line"],
                end_line=item["at"]["end_line"],
                owner_class=F.try_element_at(known["class_names"], item["at"]["class_start"]),
            )

        rest = _uncovered(known["s"]["src"]["raw_lines"], known["s"]["extents"])
        rest_block = F.filter(
            F.array(_block(code_type=F.lit("global"), code=rest)), lambda b: b["code"].isNotNull()
        )
        return F.concat(
            F.transform(of_kind("class"), class_block),
            F.transform(of_kind("function"), function_block),
            F.transform(of_kind("method"), function_block),
            rest_block,
        )

    def from_text(masked: Column) -> Column:
        return bind(
            F.struct(
                masked.alias("masked"),
                F.split(masked, "\n").alias("masked_lines"),
                F.split(text, "\n").alias("raw_lines"),
            ),
            from_mask,
        )

    return bind(mask(text, spec), from_text)


def statement_type(statement: Column) -> Column:
    """Type of one masked statement by its leading word; a WITH clause takes the verb outside its parentheses."""
    first = F.lower(F.regexp_extract(statement, r"^\s*([A-Za-z]+)", 1))
    words = F.regexp_extract_all(statement, F.lit(r"(?i)[()]|\b(?:select|insert|update|delete)\b"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("verb"))
    main_verb = F.aggregate(
        words,
        zero,
        lambda acc, w: F.struct(
            (acc["depth"] + F.when(w == "(", 1).when(w == ")", -1).otherwise(0)).alias("depth"),
            F.when(acc["verb"].isNull() & (acc["depth"] == 0) & ~w.isin("(", ")"), F.lower(w))
            .otherwise(acc["verb"])
            .alias("verb"),
        ),
        lambda acc: acc["verb"],
    )
    return (
        F.when(first.isin("select", "insert", "update", "delete"), first)
        .when(first == "with", main_verb)
        .when(statement.rlike(r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\b"), F.lit("function"))
    )


def _statement_blocks(text: Column, spec: LanguageSpec) -> Column:
    zero = {"line": F.lit(0), "col": F.lit(0)}
    kind = "array<struct<col:int,length:int,line:int,breaks:int,kind:string>>"

    def column_after(text: Column, col: Column) -> Column:
        """Column behind a text that begins in column ``col``."""
        tail = F.length(F.substring_index(text, "\n", -1))
        return F.when(F.contains(text, F.lit("\n")), tail).otherwise(col + F.length(text))

    def step(acc: Column, piece: Column) -> Column:
        lead = F.regexp_extract(piece, r"^\s*", 0)
        body = F.regexp_replace(piece, r"^\s+|[\s;]+$", "")
        return bind(
            F.struct(lead.alias("lead"), body.alias("body"), statement_type(piece).alias("kind")),
            lambda p: record(
                acc,
                ["line", "col", "done"],
                line=acc["line"] + _breaks(piece),
                col=column_after(piece, acc["col"]),
                **append_if(
                    p["kind"].isNotNull(),
                    acc,
                    F.array(
                        F.struct(
                            column_after(p["lead"], acc["col"]).alias("col"),
                            F.length(p["body"]).alias("length"),
                            (acc["line"] + _breaks(p["lead"])).alias("line"),
                            _breaks(p["body"]).alias("breaks"),
                            p["kind"].alias("kind"),
                        )
                    ),
                ),
            ),
        )

    def from_mask(src: Column) -> Column:
        pieces = F.regexp_extract_all(src["masked"], F.lit(r"[^;]*+;|[^;]++"), F.lit(0))
        found = bind(pieces, lambda p: collecting_fold(p, zero, kind, step, lambda _, done: done))

        def code(s: Column) -> Column:
            covered = F.slice(src["lines"], s["line"] + 1, s["breaks"] + 1)
            return F.substr(F.array_join(covered, "\n"), s["col"] + 1, s["length"])

        return F.transform(
            found,
            lambda s: _block(
                code_type=s["kind"],
                code=code(s),
                start_line=s["line"],
                end_line=s["line"] + s["breaks"],
            ),
        )

    return bind(F.struct(F.split(text, "\n").alias("lines"), mask(text, spec).alias("masked")), from_mask)


def blocks_of(text: Column, language: Column, languages=DEFAULT_LANGUAGES) -> Column:
    """Array of blocks of one text; NULL for a language without a handler."""
    out = F.lit(None).cast(f"array<{BLOCK.simpleString()}>")
    for spec in languages:
        cut = _statement_blocks if spec.layout == "statements" else _structured_blocks
        out = F.when(language == spec.name, cut(text, spec)).otherwise(out)
    return out


@lru_cache(maxsize=64)
def _file_blocks(content: str, path: str, languages: tuple[LanguageSpec, ...], gateway: int) -> Column:
    """Blocks by column names; building the expression takes seconds, so one is kept per language table."""
    return blocks_of(F.col(content), language_of(F.col(path), languages), languages)


def file_blocks(content: str = "content", path: str = "filepath", languages=DEFAULT_LANGUAGES) -> Column:
    """Array of blocks of the file in the row."""
    return _file_blocks(content, path, tuple(languages), id(SparkContext._gateway))


def extract_blocks(files: DataFrame, languages=DEFAULT_LANGUAGES, content: str = "content") -> DataFrame:
    """One row per block, in the order classes, functions, methods, global; other columns are carried."""
    carried = [c for c in files.columns if c not in (content, "language")]
    lang = language_of(F.col("filepath"), languages)
    found = files.select(
        *carried, lang.alias("language"), file_blocks(content, "filepath", languages).alias("blocks")
    )
    rows = explode_once(found, [*carried, "language"], F.col("blocks"), "ordinal", "block")
    return rows.select(*carried, "language", "ordinal", "block.*")


def function_blocks(blocks: DataFrame) -> DataFrame:
    """Functions at any depth."""
    return blocks.filter(F.col("code_type") == "function")


def class_blocks(blocks: DataFrame) -> DataFrame:
    """Classes with parents as inputs and an outline of their methods as summary."""
    return blocks.filter(F.col("code_type") == "class")


def method_blocks(blocks: DataFrame) -> DataFrame:
    """C4: functions that belong to a class, which stays in owner_class."""
    return blocks.filter((F.col("code_type") == "function") & F.col("owner_class").isNotNull())


def global_block(blocks: DataFrame) -> DataFrame:
    """What is left of a file outside its blocks."""
    return blocks.filter(F.col("code_type") == "global")


def sql_statements(blocks: DataFrame) -> DataFrame:
    """Top-level statements of SQL files."""
    return blocks.filter(F.col("language") == "sql")


def spans(blocks: DataFrame) -> DataFrame:
    """Name and 0-based lines of every class, function, method or statement."""
    name = F.when(F.col("language") == "sql", F.col("code_type")).otherwise(
        F.coalesce("class_name", "function_name")
    )
    return blocks.filter(F.col("start_line").isNotNull()).select(
        *[c for c in ("repo_id", "filepath") if c in blocks.columns],
        name.alias("name"),
        "start_line",
        "end_line",
    )


def outline(blocks: Column) -> Column:
    """C12 text of one file from its array of blocks."""

    def listed(label: str, items: Column) -> Column:
        return F.when(items.isNotNull(), F.concat(F.lit(f"\n\t{label}: "), F.array_join(items, ", "))).otherwise(
            F.lit("")
        )

    def lines(b: Column) -> Column:
        methods = F.transform(
            F.filter(
                F.split(F.coalesce(b["summary"], F.lit("")), "\n"),
                lambda t: F.ltrim(t).startswith("method:"),
            ),
            lambda t: F.concat(F.lit("\t"), strip_space(t)),
        )
        return (
            F.when(
                b["code_type"] == "class",
                F.concat(
                    F.array(
                        F.concat(F.lit("Class: "), b["class_name"], listed("Parent Classes", b["inputs"]))
                    ),
                    methods,
                ),
            )
            .when(
                b["code_type"].isin("function", "method"),
                F.array(
                    F.concat(
                        F.when(b["code_type"] == "method", F.lit("Method (within class): ")).otherwise(
                            F.lit("Function: ")
                        ),
                        F.coalesce(b["function_name"], F.lit("None")),
                        listed("Input Parameters", b["inputs"]),
                        listed("Output Parameters", b["outputs"]),
                    )
                ),
            )
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_join(F.flatten(F.transform(blocks, lines)), "\n")


def summarize_files(
    files: DataFrame, requests: DataFrame | None = None, languages=DEFAULT_LANGUAGES
) -> DataFrame:
    """Outline per file; with ``requests(filepath)`` every asked path gets an outline or a message."""
    outlines = files.select(
        "filepath",
        outline(file_blocks("content", "filepath", languages)).alias("outline"),
    )
    if requests is None:
        return outlines
    from corpusloom.operators.files import requested_text

    return requested_text(requests, outlines, "outline")


def is_balanced(text: Column, language: Column, languages=DEFAULT_LANGUAGES) -> Column:
    """Brackets nest and close and no quote is left open; an empty text is valid."""
    pairs = {")": "(", "]": "[", "}": "{"}

    def check(masked: Column, spec: LanguageSpec) -> Column:
        signs = F.regexp_extract_all(masked, F.lit(r"[()\[\]{}]"), F.lit(0))

        def step(stack: Column, sign: Column) -> Column:
            out = F.concat(stack, sign)
            for shut, opening in pairs.items():
                out = F.when(
                    sign == shut,
                    F.when(
                        F.right(stack, F.lit(1)) == opening,
                        F.substr(stack, F.lit(1), F.length(stack) - 1),
                    ).otherwise(F.lit("!")),
                ).otherwise(out)
            return F.when(stack.startswith("!"), stack).otherwise(out)

        quotes = "[\"'`]" if "`" in spec.tokens else "[\"']"
        return (F.aggregate(signs, F.lit(""), step) == "") & ~masked.rlike(rf"{quotes}(?!\x01)")

    def checker(spec: LanguageSpec):
        return lambda masked: check(masked, spec)

    out = F.lit(None).cast("boolean")
    for spec in languages:
        verdict = bind(mask(text, spec), checker(spec))
        out = F.when(language == spec.name, verdict).otherwise(out)
    return out
