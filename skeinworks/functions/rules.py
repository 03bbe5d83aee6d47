"""Query intents, hints, score rules and file classes as column expressions over rule tables that are plain data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that trigger a hint group, the seeds that it adds, and words of flow questions.
ENTRY_PHRASES = ["从哪里进入", "从哪进入", "进入系统", "gcode进入", "g-code进入"]
CHAIN_WORDS = ["变成"]
STRUCTURE_WORDS = ["motion", "planner", "stepper"]
HALT_WORDS = ["halt", "stop", "emergency", "停止", "报警"]
HALT_SYNONYMS = ["急停", "紧急停止"]
MODULE_WORDS = ["模块系统", "注册", "通信", "触发"]
FLOW_WORDS = ["进入", "入口", "变成", "命令", "如何", "怎么", "怎样", "触发", "注册", "通信", "halt", "stop", "emergency", "停止", "报警"]
SEEDS = {
    "entry": ["gcode", "GcodeDispatch", "SerialConsole", "Player", "on_console_line_received", "ON_CONSOLE_LINE_RECEIVED", "on_main_loop", "call_event", "console_line"],
    "motion_chain": ["Robot", "Planner", "Conveyor", "StepTicker", "on_gcode_received", "append_block", "process_move", "queue_head_block", "step_tick", "GcodeDispatch"],
    "motion_structure": ["Planner", "StepTicker", "StepperMotor", "Robot", "Block", "Conveyor", "append_block", "calculate_trapezoid", "step_tick", "manual_step"],
    "halt": ["halt", "ON_HALT", "KillButton", "immediate_halt", "Endstops", "on_halt", "SerialConsole", "halt_flag", "GcodeDispatch", "Kernel", "Conveyor", "StepperMotor"],
    "module": ["Module", "Kernel", "register_for_event", "call_event", "PublicData", "add_module", "get_value", "set_value", "main", "ON_MODULE_LOADED"],
}

# Suffixes of implementation and header files, event handlers that tell nothing, markers of generated files.
IMPLEMENTATION = [".c", ".cc", ".cpp", ".cxx"]
HEADER = [".h", ".hh", ".hpp", ".hxx"]
GENERIC_HANDLERS = ["on_main_loop", "on_idle", "on_second_tick", "on_module_loaded", "on_enable", "on_get_public_data", "on_set_public_data"]
GENERATED = ["generated", "do not edit", "auto-generated", "autogenerated", "automatically generated"]
INTENTS = ["symbol_lookup", "entry_point", "call_flow", "error_trace", "module_summary", "config_lookup", "unknown"]

# Score of a chunk's type, and of its other traits.
TYPE_BONUS = {"function": 3.0, "class": 2.0, "file_overview": 1.0}
IMPLEMENTATION_BONUS, HEADER_CLASS_MALUS, CONSTRUCTOR_MALUS, ENTRY_BONUS, HEADER_BOOST = 4.0, 3.0, 18.0, 6.0, 14.0
COHERENT, INCOHERENT = 8.0, 5.0


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def folded(query: Column) -> Column:
    """Lower case, with the hyphen of one code word dropped."""
    return F.replace(F.lower(query), F.lit("g-code"), F.lit("gcode"))


def hints(query: Column, synonyms: bool = True) -> dict[str, Column]:
    """Name of each hint group and whether the query triggers it."""
    low = folded(query)
    return {
        "entry": any_of(query, ENTRY_PHRASES) | any_of(low, ENTRY_PHRASES) | (F.contains(query, F.lit("进入")) & F.contains(low, F.lit("gcode"))),
        "motion_chain": any_of(query, CHAIN_WORDS) | (F.contains(query, F.lit("运动")) & F.contains(query, F.lit("命令"))),
        "motion_structure": any_of(low, STRUCTURE_WORDS),
        "halt": any_of(low, HALT_WORDS + (HALT_SYNONYMS if synonyms else [])),
        "module": any_of(query, MODULE_WORDS),
    }


def hint_names(query: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c, name) for name, c in hints(query).items())))


def expanded(query: Column, tokens: Column) -> Column:
    """The tokens, then the lower-cased seeds of each triggered group in the groups' order, each once."""
    added = [F.when(c, F.array(*(F.lit(s.lower()) for s in SEEDS[name]))).otherwise(F.array().cast("array<string>")) for name, c in hints(query).items()]
    return F.array_union(tokens, F.flatten(F.array(*added)))


def flow_question(query: Column) -> Column:
    return any_of(folded(query), FLOW_WORDS) | any_of(query, FLOW_WORDS)


def structure_question(query: Column) -> Column:
    h = hints(query)
    return h["motion_structure"] | h["halt"] | h["module"]


def entry_question(query: Column) -> Column:
    return hints(query)["entry"]


def suffix(file: Column) -> Column:
    return F.regexp_extract(file, r"[^/.](\.[^./]*)$", 1)


def stem(file: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(file, "/", -1), r"(?<=.)\.[^.]*$", ""))


def is_entry(symbol: Column, start: Column, symbol_start: Column) -> Column:
    """The chunk begins where its symbol does."""
    return (F.coalesce(symbol, F.lit("")) != "") & (start == F.coalesce(symbol_start, start))


def chunk_bonus(type_: Column, file: Column, symbol: Column, owner: Column, start: Column, symbol_start: Column) -> Column:
    """What a chunk scores by type, kind of file, and place of its symbol."""
    s = suffix(file)
    base = F.lit(0.0)
    for name, points in TYPE_BONUS.items():
        base = F.when(type_ == name, points).otherwise(base)
    kind = F.when((type_ == "function") & s.isin(*IMPLEMENTATION), IMPLEMENTATION_BONUS).when((type_ == "class") & s.isin(*HEADER), -HEADER_CLASS_MALUS).otherwise(0.0)
    built = F.when((F.coalesce(symbol, F.lit("")) != "") & symbol.eqNullSafe(owner), -CONSTRUCTOR_MALUS).otherwise(0.0)
    return base + kind + built + F.when(is_entry(symbol, start, symbol_start), ENTRY_BONUS).otherwise(0.0)


def holds(name: Column, tokens: Column) -> Column:
    """A token is the name, or has four letters or more and lies in it."""
    return (name != "") & F.exists(tokens, lambda t: (name == t) | ((F.length(t) >= 4) & F.contains(name, t)))


def own_handler(symbol: Column) -> Column:
    """An event handler that tells what its class does."""
    return F.startswith(symbol, F.lit("on_")) & ~symbol.isin(*GENERIC_HANDLERS)


def coherence(file: Column, symbol: Column, owner: Column, tokens: Column, names_module: Column) -> Column:
    """8 if the file's stem or the class is a token or holds one of four letters; else -5 for a telling handler where the query names a module, -10 for two registrars that were not asked for."""
    return coherent(stem(file), F.lower(F.coalesce(owner, F.lit(""))), own_handler(F.coalesce(symbol, F.lit(""))), tokens, names_module)


def coherent(name: Column, owner: Column, handler: Column, tokens: Column, names_module: Column) -> Column:
    """`coherence` of a chunk whose stem, lower-cased class and telling handler are known."""
    registers = F.array_contains(tokens, "register_for_event")
    player = (name == "player") & ~F.array_contains(tokens, "player") & (registers | F.array_contains(tokens, "add_module"))
    return (
        F.when(holds(name, tokens) | holds(owner, tokens), COHERENT)
        .when(F.coalesce(handler & names_module, F.lit(False)), -INCOHERENT)
        .when(player | ((name == "switch") & registers), -2 * INCOHERENT)
        .otherwise(0.0)
    )


def symbol_weight(name: Column, kind: Column, file: Column, owner: Column, line: Column, start: Column, query: Column, tokens: Column) -> Column:
    """What a symbol that a token names is worth: 85, 110 if no function or class, 92 for a coherent handler where a flow or an entry is asked for."""
    own = stem(file)
    coherent = F.array_contains(tokens, own) | F.array_contains(tokens, F.lower(F.coalesce(owner, F.lit("")))) | F.exists(tokens, lambda t: (F.length(t) >= 4) & F.contains(own, t))
    handler = (entry_question(query) & (name == "on_main_loop")) | (flow_question(query) & own_handler(name) & (start == line))
    return F.when(kind.isin("macro", "enum", "typedef"), 110.0).when(coherent & handler, 92.0).otherwise(85.0)


def header_boost(file: Column, query: Column) -> Column:
    return F.when(hints(query)["module"] & module_header(file), HEADER_BOOST).otherwise(0.0)


def module_header(file: Column) -> Column:
    return suffix(file).isin(*HEADER) & stem(file).isin("module", "kernel")


def has_needle(blob: Column, needles: Column) -> Column:
    """True without needles, or if the lower-cased blob holds any of them."""
    low = F.lower(blob)
    return (F.size(needles) == 0) | F.exists(needles, lambda m: F.contains(low, F.lower(m)))


def excludes(text: Column) -> Column:
    """Distinct non-empty trimmed parts of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p != ""))


def note_map(note: Column) -> Column:
    """map of 'k=v; k=v', keys and values trimmed; parts without '=' are dropped, and of equal keys the last counts."""
    parts = F.filter(F.split(note, ";"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def generated(text: Column, lines: Column) -> Column:
    """A marker in the first 20,000 characters, or ten pragma lines that are 8 % of the first 300."""
    head = F.slice(lines, 1, 300)
    pragmas = F.size(F.filter(head, lambda line: line.rlike(r"^\s*#pragma")))
    return any_of(F.lower(F.substring(text, 1, 20000)), GENERATED) | ((pragmas >= 10) & (pragmas >= 0.08 * F.size(head)))


def plan(reply: Column, question: Column) -> Column:
    """struct of a planner's reply: fenced JSON, else the widest {...}, else the text; what doesn't parse asks the question itself."""
    text = plan_text(reply)
    return plan_of(plan_json(text), plan_parses(text), question)


def plan_text(reply: Column) -> Column:
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(F.rlike(reply, F.lit(r"(?is)```(?:json)?\s*.*?\s*```")), F.coalesce(F.nullif(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), F.lit("")), fenced)).when(braces != "", braces).otherwise(reply)


def plan_json(text: Column) -> Column:
    return F.from_json(text, "intent string, symbols array<string>, search_queries array<string>, must_have array<string>")


def plan_parses(text: Column) -> Column:
    return F.startswith(F.trim(text), F.lit("{")) & F.try_parse_json(text).isNotNull()


def plans(rows: DataFrame, reply: Column, question: Column, name: str) -> DataFrame:
    """rows with `plan` as `name`. Each step is a column of its own, as fields of one expression would each read the reply again."""
    steps = rows.withColumn("__reply", reply).withColumn("__text", plan_text(F.col("__reply")))
    steps = steps.withColumn("__json", plan_json(F.col("__text"))).withColumn("__parses", plan_parses(F.col("__text")))
    return steps.withColumn(name, plan_of(F.col("__json"), F.col("__parses"), question)).drop("__reply", "__text", "__json", "__parses")


def plan_of(p: Column, parses: Column, question: Column) -> Column:
    ok = p.isNotNull() & parses

    def strings(a):
        return F.coalesce(F.filter(F.transform(a, lambda x: F.trim(x)), lambda s: s != ""), F.array().cast("array<string>"))

    asked = strings(p["search_queries"])
    return F.struct(
        F.when(ok & p["intent"].isin(*INTENTS), p["intent"]).otherwise("unknown").alias("intent"),
        F.when(ok, strings(p["symbols"])).otherwise(F.array().cast("array<string>")).alias("symbols"),
        F.when(ok & (F.size(asked) > 0), asked).otherwise(F.array(question)).alias("queries"),
        F.when(ok, strings(p["must_have"])).otherwise(F.array().cast("array<string>")).alias("must_have"),
        F.coalesce(~ok, F.lit(True)).alias("fallback"),
    )


def sub_queries(question: Column, asked: Column, symbols: Column, most: int = 10) -> Column:
    """The question, the planned queries and the symbols, trimmed, without repeats that differ in case only, the first `most`."""
    every = F.filter(F.transform(F.concat(F.array(question), asked, symbols), lambda x: F.trim(x)), lambda q: q != "")
    return F.slice(F.filter(every, lambda q, i: ~F.exists(F.slice(every, 1, i), lambda p: F.lower(p) == F.lower(q))), 1, most)


def cited_path(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("src/")), path).otherwise(F.concat(F.lit("src/"), path))


def mentioned(file: Column, answer: Column) -> Column:
    """The answer names the file: its path, or in any case its base name."""
    return F.contains(answer, file) | F.contains(F.lower(answer), F.lower(F.substring_index(file, "/", -1)))
