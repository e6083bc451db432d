"""Registered queries over the function library: a column for each function, with the SQL that it must agree with."""

from __future__ import annotations

from .queries import LINE, LIT, MORE, PLUS, POSITIVE, VEC, family

INTS, STRINGS, DOUBLES = ({"type": "array", "items": t} for t in ("int", "string", "double"))


def fn(ret, body, **params):
    return {"params": [{k: t} for k, t in params.items()], "ret": ret, "do": [body]}


def new(kind, *items):
    return {"new": list(items), "type": kind}


def ints(*items):
    return new(INTS, *items)


TEXT = fn("string", {"s.number": ["v"]}, v="int")


def joined(array):
    """An array of ints as text."""
    return {"s.join": [{"a.map": [array, TEXT]}, LIT(",")]}


def sql_joined(array):
    return f"array_to_string(list_transform({array}, lambda v: CAST(v AS VARCHAR)), ',')"


LESS = fn("boolean", {"<": ["v", "w"]}, v="int", w="int")
MINUS = fn("int", {"-": ["v", "w"]}, v="int", w="int")
TWICE = fn(INTS, ints("v", {"u-": ["v"]}), v="int")
BELOW2 = fn("boolean", {"<": ["v", 2]}, v="int")
DOUBLE_ALL = {"a.map": ["a", fn("int", {"*": ["v", 2]}, v="int")]}
ranked = lambda sign, n: f"list_transform(list_sort(list_transform(range(0, len(a)), lambda i: {{'v': {sign}a[i + 1], 'i': i}}))[:{n}], lambda z: z.i)"
prefix = "(coalesce(list_position(list_transform(a, lambda v: v < 2), false), len(a) + 1) - 1)"
family("fn_array_items", "embeddings", ["vec_id"], VEC, [
    ("subseqto", joined({"a.subseqto": ["a", 1, 3, ints(7, 8, 9)]}), sql_joined("list_concat(list_concat(a[1:1], [7, 8, 9]), a[4:])")),
    ("rindex", {"a.rindex": ["a", 0]}, "CAST(CASE WHEN list_contains(a, 0) THEN len(a) - list_position(list_reverse(a), 0) ELSE -1 END AS INTEGER)"),
    ("starts", {"a.startswith": ["a", {"a.subseq": ["a", 0, 2]}]}, "true"),
    ("starts_item", {"a.startswith": ["a", 0]}, "a[1] = 0"),
    ("ends", {"a.endswith": ["a", ints(0, 0)]}, "a[-2:] = [0, 0]"),
    ("ends_item", {"a.endswith": ["a", 1]}, "a[-1] = 1"),
    ("cycle", joined({"a.cycle": ["a", 5, 3]}), sql_joined("list_concat(a[-2:], [5])")),
    ("insert", joined({"a.insert": ["a", 2, 99]}), sql_joined("list_concat(list_concat(a[1:2], [99]), a[3:])")),
    ("replace", joined({"a.replace": ["a", 2, 99]}), sql_joined("list_concat(list_concat(a[1:2], [99]), a[4:])")),
    ("remove", joined({"a.remove": ["a", 2]}), sql_joined("list_concat(a[1:2], a[4:])")),
    ("remove_range", joined({"a.remove": ["a", 1, 3]}), sql_joined("list_concat(a[1:1], a[4:])")),
    ("rotate", joined({"a.rotate": ["a", 2]}), sql_joined("list_concat(a[3:], a[1:2])")),
    ("sort_by", joined({"a.sortLT": ["a", MORE]}), sql_joined("list_reverse_sort(a)")),
    ("shuffled", joined({"a.sort": [{"a.shuffle": ["a"]}]}), sql_joined("list_sort(a)")),
    ("max_by", {"a.maxLT": ["a", LESS]}, "list_max(a)"),
    ("max_n_by", joined({"a.maxNLT": ["a", 3, LESS]}), sql_joined("list_reverse_sort(a)[:3]")),
    ("min_n_by", joined({"a.minNLT": ["a", 3, LESS]}), sql_joined("list_sort(a)[:3]")),
    ("argmax_by", {"a.argmaxLT": ["a", LESS]}, "CAST(list_position(a, list_max(a)) - 1 AS INTEGER)"),
    ("argmin_by", {"a.argminLT": ["a", LESS]}, "CAST(list_position(a, list_min(a)) - 1 AS INTEGER)"),
    ("argmax_n", joined({"a.argmaxN": ["a", 3]}), sql_joined(ranked("-", 3))),
    ("argmin_n", joined({"a.argminN": ["a", 3]}), sql_joined(ranked("", 3))),
    ("argmax_n_by", joined({"a.argmaxNLT": ["a", 3, LESS]}), sql_joined(ranked("-", 3))),
    ("argmin_n_by", joined({"a.argminNLT": ["a", 3, LESS]}), sql_joined(ranked("", 3))),
    ("product", {"a.product": [{"a.subseq": ["a", 0, 3]}]}, "a[1] * a[2] * a[3]", 6),
    ("lnsum", {"a.lnsum": [{"a.map": ["d", fn("double", {"m.exp": ["v"]}, v="double")]}]}, "list_sum(d)", 6),
    ("geomean", {"a.geomean": [{"a.map": ["d", fn("double", {"m.exp": ["v"]}, v="double")]}]}, "exp(list_avg(d))", 6),
    ("mode", {"a.mode": ["a"]}, "list_sort(list_transform(list_distinct(a), lambda v: {'c': -len(list_filter(a, lambda w: w = v)), 'v': v}))[1].v"),
    ("grouped", {"map.len": [{"a.groupby": ["a", TEXT]}]}, "CAST(len(list_distinct(a)) AS INTEGER)"),
])
family("fn_array_sets", "embeddings", ["vec_id"], VEC, [
    ("seteq", {"a.seteq": ["a", {"a.reverse": ["a"]}]}, "true"),
    ("seteq_tail", {"a.seteq": ["a", {"a.tail": ["a"]}]}, "list_contains(a[2:], a[1])"),
    ("union_", {"a.len": [{"a.union": ["a", DOUBLE_ALL]}]}, "CAST(len(list_distinct(list_concat(a, list_transform(a, lambda v: v * 2)))) AS INTEGER)"),
    ("diff", joined({"a.sort": [{"a.diff": ["a", DOUBLE_ALL]}]}), sql_joined("list_sort(list_filter(list_distinct(a), lambda v: NOT list_contains(list_transform(a, lambda w: w * 2), v)))")),
    ("symdiff", {"a.len": [{"a.symdiff": ["a", DOUBLE_ALL]}]}, "CAST(len(list_filter(list_distinct(a), lambda v: NOT list_contains(list_transform(a, lambda w: w * 2), v))) + len(list_filter(list_distinct(list_transform(a, lambda v: v * 2)), lambda v: NOT list_contains(a, v))) AS INTEGER)"),
    ("subset", {"a.subset": ["a", {"a.tail": ["a"]}]}, "list_contains(a[2:], a[1])"),
    ("disjoint", {"a.disjoint": ["a", ints(1, 2)]}, "NOT list_has_any(a, [1, 2])"),
    ("with_index", joined({"a.mapWithIndex": ["a", fn("int", {"+": ["k", "v"]}, k="int", v="int")]}), sql_joined("list_transform(a, lambda v, i: CAST(v + i - 1 AS INTEGER))")),
    ("even_places", joined({"a.filterWithIndex": ["a", fn("boolean", {"==": [{"%": ["k", 2]}, 0]}, k="int", v="int")]}), sql_joined("list_filter(a, lambda v, i: (i - 1) % 2 = 0)")),
    ("filter_map", joined({"a.filterMap": ["a", fn(["int", "null"], {"if": {">": ["v", 0]}, "then": {"*": ["v", 3]}, "else": None}, v="int")]}), sql_joined("list_transform(list_filter(a, lambda v: v > 0), lambda v: v * 3)")),
    ("filter_map_index", joined({"a.filterMapWithIndex": ["a", fn(["int", "null"], {"if": {">": ["k", 2]}, "then": "v", "else": None}, k="int", v="int")]}), sql_joined("a[4:]")),
    ("flat_map", joined({"a.flatMap": ["a", TWICE]}), sql_joined("flatten(list_transform(a, lambda v: [v, -v]))")),
    ("flat_map_index", joined({"a.flatMapWithIndex": ["a", fn(INTS, ints("k", "v"), k="int", v="int")]}), sql_joined("flatten(list_transform(a, lambda v, i: [CAST(i - 1 AS INTEGER), v]))")),
    ("zipmap", joined({"a.zipmap": ["a", {"a.reverse": ["a"]}, PLUS]}), sql_joined("list_transform(list_zip(a, list_reverse(a)), lambda z: z[1] + z[2])")),
    ("zipmap_index", joined({"a.zipmapWithIndex": ["a", {"a.reverse": ["a"]}, fn("int", {"+": ["k", {"-": ["v", "w"]}]}, k="int", v="int", w="int")]}), sql_joined("list_transform(list_zip(a, list_reverse(a)), lambda z, i: CAST(i - 1 + z[1] - z[2] AS INTEGER))")),
    ("reduce_right", {"a.reduceRight": ["a", MINUS]}, "list_reduce(list_reverse(a), lambda x, y: y - x)"),
    ("fold_right", {"a.foldRight": ["a", 5, MINUS]}, "list_reduce(list_concat([5], list_reverse(a)), lambda x, y: y - x)"),
    ("take", joined({"a.takeWhile": ["a", BELOW2]}), sql_joined(f"a[:{prefix}]")),
    ("dropped", joined({"a.dropWhile": ["a", BELOW2]}), sql_joined(f"a[{prefix} + 1:]")),
    ("corresponds", {"a.corresponds": ["a", {"a.reverse": ["a"]}, fn("boolean", {"==": ["v", "w"]}, v="int", w="int")]}, "a = list_reverse(a)"),
    ("corresponds_index", {"a.correspondsWithIndex": ["a", "a", fn("boolean", {"<": [{"-": ["v", "w"]}, {"+": ["k", 1]}]}, k="int", v="int", w="int")]}, "true"),
    ("combinations", {"a.len": [{"a.combinations": [{"a.subseq": ["a", 0, 5]}, 2]}]}, "CAST(10 AS INTEGER)"),
    ("combination", joined({"a.last": [{"a.combinations": [{"a.subseq": ["a", 0, 5]}, 2]}]}), sql_joined("a[4:5]")),
    ("permutations", {"a.len": [{"a.permutations": [{"a.subseq": ["a", 0, 4]}]}]}, "CAST(24 AS INTEGER)"),
    ("permutation", joined({"a.last": [{"a.permutations": [{"a.subseq": ["a", 0, 4]}]}]}), sql_joined("list_reverse(a[1:4])")),
    ("flattened", joined({"a.flatten": [new({"type": "array", "items": INTS}, "a", ints(1), "a")]}), sql_joined("list_concat(list_concat(a, [1]), a)")),
])

KEYED = {"n": ("l_linenumber", "l_linenumber"), "q": ("cast(l_quantity as int)", "CAST(l_quantity AS INTEGER)"), "m": ("map('a', cast(l_linenumber as int), 'b', cast(l_quantity as int), 'c', 7)", "1"), "o": ("map('b', 1, 'd', cast(l_linenumber as int))", "1")}
MAP = {"type": "map", "values": "int"}


def shown(expression):
    """A map of ints as text, in order of its keys."""
    pair = fn("string", {"s.concat": ["k", {"s.number": [{"attr": "z", "path": ["k"]}]}]}, k="string")
    return {"do": [{"let": {"z": expression}}, {"s.join": [{"a.map": [{"a.sort": [{"map.keys": ["z"]}]}, pair]}, LIT(",")]}]}


def sql_shown(**values):
    return "concat_ws(',', " + ", ".join(f"'{k}' || CAST({v} AS VARCHAR)" for k, v in values.items()) + ")"


top = lambda sign, n: f"array_to_string(list_transform(list_sort([{{'v': {sign}n, 'k': 'a'}}, {{'v': {sign}q, 'k': 'b'}}, {{'v': {sign}7, 'k': 'c'}}])[:{n}], lambda z: z.k), ',')"
ONE, PAIR = fn("int", {"+": ["v", 1]}, v="int"), fn(MAP, {"map.add": [{"value": {}, "type": MAP}, {"s.concat": ["k", LIT("x")]}, "v"]}, k="string", v="int")
SINGLE = fn(MAP, {"map.add": [{"value": {}, "type": MAP}, {"s.number": ["v"]}, "v"]}, v="int")
KEYS = lambda e: {"s.join": [e, LIT(",")]}
ABC = new(STRINGS, LIT("a"), LIT("c"), LIT("z"))
family("fn_map", "lineitem", LINE, KEYED, [
    ("len", {"map.len": ["m"]}, "CAST(3 AS INTEGER)"),
    ("keys", KEYS({"a.sort": [{"map.keys": ["m"]}]}), "'a,b,c'"),
    ("values", {"a.sum": [{"map.values": ["m"]}]}, "n + q + 7", 3),
    ("has_key", {"map.containsKey": ["m", LIT("d")]}, "false"),
    ("has_key_by", {"map.containsKey": ["o", fn("boolean", {"==": ["k", LIT("d")]}, k="string")]}, "true"),
    ("has_value", {"map.containsValue": ["m", 3]}, "n = 3 OR q = 3"),
    ("add", shown({"map.add": ["m", LIT("b"), 5]}), sql_shown(a="n", b="5", c="7")),
    ("remove", shown({"map.remove": ["m", LIT("b")]}), sql_shown(a="n", c="7")),
    ("only", shown({"map.only": ["m", ABC]}), sql_shown(a="n", c="7")),
    ("except_", shown({"map.except": ["m", ABC]}), sql_shown(b="q")),
    ("update_", shown({"map.update": ["m", "o"]}), sql_shown(a="n", b="1", c="7", d="n")),
    ("split", {"a.len": [{"map.split": ["m"]}]}, "CAST(3 AS INTEGER)"),
    ("join_", shown({"map.join": [new({"type": "array", "items": MAP}, "m", "o")]}), sql_shown(a="n", b="1", c="7", d="n")),
    ("argmax", {"map.argmax": ["m"]}, top("-", 1)),
    ("argmin", {"map.argmin": ["m"]}, top("", 1)),
    ("argmax_by", {"map.argmaxLT": ["m", LESS]}, top("-", 1)),
    ("argmin_by", {"map.argminLT": ["m", LESS]}, top("", 1)),
    ("argmax_n", KEYS({"map.argmaxN": ["m", 2]}), top("-", 2)),
    ("argmin_n", KEYS({"map.argminN": ["m", 2]}), top("", 2)),
    ("argmax_n_by", KEYS({"map.argmaxNLT": ["m", 2, LESS]}), top("-", 2)),
    ("argmin_n_by", KEYS({"map.argminNLT": ["m", 2, LESS]}), top("", 2)),
    ("set_", {"a.sum": [{"map.fromset": [{"map.toset": [ints("n", "q", 7)]}]}]}, "list_sum(list_distinct([n, q, 7]))", 3),
    ("in_", {"map.in": [{"map.toset": [ints("n", "q", 7)]}, 3]}, "list_contains([n, q, 7], 3)"),
])
family("fn_map_sets", "lineitem", LINE, KEYED, [
    ("union_", {"map.len": [{"map.union": ["m", "o"]}]}, "CAST(4 AS INTEGER)"),
    ("intersection", KEYS({"map.keys": [{"map.intersection": ["m", "o"]}]}), "'b'"),
    ("diff", shown({"map.diff": ["m", "o"]}), sql_shown(a="n", c="7")),
    ("symdiff", shown({"map.symdiff": ["m", "o"]}), sql_shown(a="n", c="7", d="n")),
    ("subset", {"map.subset": [{"map.remove": ["o", LIT("d")]}, "m"]}, "true"),
    ("not_subset", {"map.subset": ["o", "m"]}, "false"),
    ("disjoint", {"map.disjoint": ["o", "m"]}, "false"),
    ("mapped", shown({"map.map": ["m", ONE]}), sql_shown(a="n + 1", b="q + 1", c="8")),
    ("mapped_key", shown({"map.mapWithKey": ["m", fn("int", {"+": ["v", {"s.len": ["k"]}]}, k="string", v="int")]}), sql_shown(a="n + 1", b="q + 1", c="8")),
    ("filtered", {"map.len": [{"map.filter": ["m", fn("boolean", {">": ["v", 6]}, v="int")]}]}, "CAST((n > 6)::INT + (q > 6)::INT + 1 AS INTEGER)"),
    ("filtered_key", shown({"map.filterWithKey": ["m", fn("boolean", {"!=": ["k", LIT("b")]}, k="string", v="int")]}), sql_shown(a="n", c="7")),
    ("filter_map", {"map.len": [{"map.filterMap": ["m", fn(["int", "null"], {"if": {">": ["v", 6]}, "then": "v", "else": None}, v="int")]}]}, "CAST((n > 6)::INT + (q > 6)::INT + 1 AS INTEGER)"),
    ("filter_map_key", {"map.len": [{"map.filterMapWithKey": ["m", fn(["int", "null"], {"if": {"==": ["k", LIT("b")]}, "then": "v", "else": None}, k="string", v="int")]}]}, "CAST(1 AS INTEGER)"),
    ("flat_map", {"map.len": [{"map.flatMap": ["m", SINGLE]}]}, "CAST(len(list_distinct([n, q, 7])) AS INTEGER)"),
    ("flat_map_key", shown({"map.flatMapWithKey": ["m", PAIR]}), sql_shown(ax="n", bx="q", cx="7")),
    ("zipmap", shown({"map.zipmap": ["m", "m", PLUS]}), sql_shown(a="2 * n", b="2 * q", c="14")),
    ("zipmap_key", shown({"map.zipmapWithKey": ["m", "m", fn("int", {"+": [{"s.len": ["k"]}, {"-": ["v", "w"]}]}, k="string", v="int", w="int")]}), sql_shown(a="1", b="1", c="1")),
    ("corresponds", {"map.corresponds": ["m", {"map.map": ["m", ONE]}, LESS]}, "true"),
    ("corresponds_key", {"map.correspondsWithKey": ["m", "m", fn("boolean", {"<": [{"+": ["v", {"s.len": ["k"]}]}, "w"]}, k="string", v="int", w="int")]}, "false"),
])
_ = POSITIVE, DOUBLES

# text, bytes, casts, times, missing values
PART = {"s": ("p_name", "p_name"), "t": ("p_type", "p_type"), "b": ("p_brand", "p_brand"), "k": ("p_partkey", "p_partkey"), "n": ("p_size", "p_size")}
UTF8 = lambda e: {"bytes.encodeUtf8": [e]}
PAIRS = {"type": "array", "items": STRINGS}
first_of = lambda p: f"CASE WHEN regexp_matches(t, '{p}') THEN strpos(t, regexp_extract(t, '{p}')) - 1 ELSE NULL END"
family("fn_text", "part", ["p_partkey"], PART, [
    ("index", joined({"re.index": ["t", LIT("[AEIOU]+L")]}), f"CASE WHEN regexp_matches(t, '[AEIOU]+L') THEN CAST({first_of('[AEIOU]+L')} AS VARCHAR) || ',' || CAST({first_of('[AEIOU]+L')} + length(regexp_extract(t, '[AEIOU]+L')) AS VARCHAR) ELSE '' END"),
    ("rindex", joined({"re.rindex": ["t", LIT("E")]}), "CASE WHEN contains(t, 'E') THEN CAST(length(t) - strpos(reverse(t), 'E') AS VARCHAR) || ',' || CAST(length(t) - strpos(reverse(t), 'E') + 1 AS VARCHAR) ELSE '' END"),
    ("indexall", {"a.len": [{"re.indexall": ["t", LIT("[AEIOU]+")]}]}, "CAST(len(regexp_extract_all(t, '[AEIOU]+')) AS INTEGER)"),
    ("groups", {"a.len": [{"re.groups": ["t", LIT("([A-Z])([A-Z])")]}]}, "CAST(CASE WHEN regexp_matches(t, '[A-Z][A-Z]') THEN 3 ELSE 0 END AS INTEGER)"),
    ("groupsall", {"a.len": [{"re.groupsall": ["t", LIT("([AEIOU])([A-Z])")]}]}, "CAST(len(regexp_extract_all(t, '([AEIOU])([A-Z])')) AS INTEGER)"),
    ("findfirst", {"ifnotnull": {"z": {"re.findfirst": ["t", LIT("[AEIOU][A-Z]")]}}, "then": "z", "else": LIT("-")}, "CASE WHEN regexp_matches(t, '[AEIOU][A-Z]') THEN regexp_extract(t, '[AEIOU][A-Z]') ELSE '-' END"),
    ("findgroups", {"s.join": [{"re.findgroupsfirst": ["t", LIT("([AEIOU])([A-Z])")]}, LIT("|")]}, "CASE WHEN regexp_matches(t, '[AEIOU][A-Z]') THEN regexp_extract(t, '([AEIOU])([A-Z])') || '|' || regexp_extract(t, '([AEIOU])([A-Z])', 1) || '|' || regexp_extract(t, '([AEIOU])([A-Z])', 2) ELSE '' END"),
    ("findgroupsall", {"s.join": [{"a.map": [{"re.findgroupsall": ["t", LIT("([AEIOU])([A-Z])")]}, fn("string", {"attr": "g", "path": [2]}, g=STRINGS)]}, LIT("")]}, "array_to_string(regexp_extract_all(t, '([AEIOU])([A-Z])', 2), '')"),
    ("replacelast", {"re.replacelast": ["t", LIT("[AEIOU]+"), LIT("-")]}, "regexp_replace(t, '^(.*?)([AEIOU]+)([^AEIOU]*)$', '\\1-\\3')"),
    ("parse_long", {"parse.long": [{"s.number": ["k"]}, 10]}, "CAST(k AS BIGINT)"),
    ("parse_hex", {"parse.int": [{"s.hex": ["k"]}, 16]}, "CAST(k AS INTEGER)"),
    ("parse_float", {"parse.float": [{"s.number": ["k"]}]}, "CAST(k AS FLOAT)", 3),
    ("as_float", {"cast.float": ["n"]}, "n", 3),
    ("as_double", {"cast.double": ["n"]}, "n", 3),
    ("fan_boolean", {"a.len": [{"a.filter": [{"cast.fanoutBoolean": ["n", 0, 20, True]}, fn("boolean", {"||": ["v", False]}, v="boolean")]}]}, "CAST(1 AS INTEGER)"),
    ("fan_int", joined({"cast.fanoutInt": ["n", 1, 4, False]}), "CONCAT_WS(',', CAST(n = 1 AS INTEGER), CAST(n = 2 AS INTEGER), CAST(n = 3 AS INTEGER))"),
    ("fan_long", {"a.sum": [{"cast.fanoutLong": ["n", 1, 30, False]}]}, "CAST(n BETWEEN 1 AND 29 AS INTEGER)", 3),
    ("fan_float", {"a.sum": [{"cast.fanoutFloat": ["n", 1, 30, True]}]}, "1", 3),
    ("fan_double", {"a.argmax": [{"cast.fanoutDouble": ["n", 0, 60, True]}]}, "n"),
    ("json", {"cast.json": ["n"]}, "CAST(n AS VARCHAR)"),
    ("json_list", {"cast.json": [ints("n", 1)]}, "'[' || CAST(n AS VARCHAR) || ',1]'"),
    ("subseq", {"bytes.toBase64": [{"bytes.subseq": [UTF8("s"), 1, -1]}]}, "base64(encode(substr(s, 2, length(s) - 2)))"),
    ("subseqto", {"bytes.toBase64": [{"bytes.subseqto": [UTF8("s"), 1, 3, UTF8("b")]}]}, "base64(encode(substr(s, 1, 1) || b || substr(s, 4)))"),
    ("ascii", {"bytes.isAscii": [UTF8("s")]}, "strlen(s) = length(s)"),
    ("not_ascii", {"bytes.isAscii": [UTF8(LIT("é"))]}, "false"),
    ("utf8", {"bytes.isUtf8": [UTF8("s")]}, "true"),
    ("not_utf8", {"bytes.isUtf8": [{"bytes.encodeLatin1": [LIT("é")]}]}, "false"),
    ("latin1", {"bytes.isLatin1": [UTF8("s")]}, "true"),
    ("utf16", {"bytes.isUtf16": [{"bytes.encodeUtf16": ["s"]}]}, "true"),
    ("utf16be", {"bytes.isUtf16be": [{"bytes.subseq": [{"bytes.encodeUtf16be": [LIT("x\U0001d11e")]}, 0, 4]}]}, "false"),
    ("utf16le", {"bytes.isUtf16le": [{"bytes.encodeUtf16le": [LIT("x\U0001d11e")]}]}, "true"),
    ("code_ascii", {"bytes.decodeAscii": [{"bytes.encodeAscii": ["s"]}]}, "s"),
    ("code_latin1", {"bytes.decodeLatin1": [{"bytes.encodeLatin1": ["s"]}]}, "s"),
    ("code_utf16", {"bytes.decodeUtf16": [{"bytes.encodeUtf16": ["s"]}]}, "s"),
    ("code_utf16be", {"bytes.decodeUtf16be": [{"bytes.encodeUtf16be": ["s"]}]}, "s"),
    ("code_utf16le", {"bytes.decodeUtf16le": [{"bytes.encodeUtf16le": ["s"]}]}, "s"),
    ("base64", {"bytes.decodeUtf8": [{"bytes.fromBase64": [{"bytes.toBase64": [UTF8("s")]}]}]}, "s"),
])
EVENT = {"t": ("unix_micros(cast(ts as timestamp)) / 1e6D", "epoch(ts)"), "w": ("case when value < 20 then null else value end", "CASE WHEN value < 20 THEN NULL ELSE value END"), "z": ("case when value < 20 then double('NaN') when value < 40 then double('Infinity') else value end", "CASE WHEN value < 20 THEN 'nan'::DOUBLE WHEN value < 40 THEN 'inf'::DOUBLE ELSE value END")}
Z = LIT("UTC")
at_utc = "(to_timestamp(t) AT TIME ZONE 'UTC')"
family("fn_time_ranges", "events", ["event_id"], EVENT, [
    ("made", {"time.makeTimestamp": [{"time.year": ["t", Z]}, {"time.monthOfYear": ["t", Z]}, {"time.dayOfMonth": ["t", Z]}, {"time.hourOfDay": ["t", Z]}, {"time.minuteOfHour": ["t", Z]}, {"time.secondOfMinute": ["t", Z]}, 0, Z]}, "floor(t)", 3),
    ("second", {"time.isSecondOfMinute": ["t", Z, 10.0, 30.0]}, f"second({at_utc}) BETWEEN 10 AND 29"),
    ("minute", {"time.isMinuteOfHour": ["t", Z, 15.0, 45.0]}, f"minute({at_utc}) BETWEEN 15 AND 44"),
    ("weekday", {"time.isDayOfWeek": ["t", Z, 1.0, 4.0]}, f"isodow({at_utc}) - 1 BETWEEN 1 AND 3"),
    ("monthday", {"time.isDayOfMonth": ["t", Z, 5.0, 20.0]}, f"day({at_utc}) BETWEEN 5 AND 19"),
    ("month", {"time.isMonthOfYear": ["t", Z, 1.0, 3.0]}, f"month({at_utc}) BETWEEN 1 AND 2"),
    ("yearday", {"time.isDayOfYear": ["t", Z, 10.0, 100.0]}, f"dayofyear({at_utc}) BETWEEN 10 AND 99"),
    ("default_null", {"impute.defaultOnNull": ["w", -1.0]}, "coalesce(w, -1)", 6),
    ("error_null", {"impute.errorOnNull": [{"impute.defaultOnNull": ["w", 0.0]}]}, "coalesce(w, 0)", 6),
    ("nan", {"impute.isnan": ["z"]}, "isnan(z)"),
    ("inf", {"impute.isinf": ["z"]}, "isinf(z)"),
    ("num", {"impute.isnum": ["z"]}, "isfinite(z)"),
    ("default_num", {"impute.defaultOnNonNum": ["z", -1.0]}, "CASE WHEN isfinite(z) THEN z ELSE -1 END", 6),
    ("error_num", {"impute.errorOnNonNum": [{"impute.defaultOnNonNum": ["z", -1.0]}]}, "CASE WHEN isfinite(z) THEN z ELSE -1 END", 6),
])

# linear algebra, metrics, interpolation, links
Q = {"x": ("l_quantity", "l_quantity"), "y": ("l_discount", "l_discount"), "t": ("l_tax", "l_tax"), "n": ("l_linenumber", "l_linenumber")}
MATRIX = {"type": "array", "items": DOUBLES}
row = lambda *v: new(DOUBLES, *v)
matrix = lambda *r: new(MATRIX, *r)
M = matrix(row("x", "y"), row("t", 2.0))
cell = lambda m, a, b: {"attr": m, "path": [a, b]}
got = lambda e, *path: {"do": [{"let": {"held": e}}, {"attr": "held", "path": [[p["string"]] if isinstance(p, dict) else p for p in path]}]}
ABS, SQ = fn("double", {"metric.absDiff": ["a", "b"]}, a="double", b="double"), fn("double", {"-": ["a", "b"]}, a="double", b="double")
V, W = row("x", "y", "t"), row(25.0, 0.05, 0.04)
BITS = lambda *e: new({"type": "array", "items": "boolean"}, *e)
B1, B2 = BITS({">": ["x", 25]}, {">": ["y", 0.05]}, {">": ["t", 0.03]}, {">": ["n", 2]}), BITS(True, False, True, True)
b = ["(x > 25)::INT", "(y > 0.05::DOUBLE)::INT", "(t > 0.03::DOUBLE)::INT", "(n > 2)::INT"]
both, only_x, only_y = f"({b[0]} + {b[2]} + {b[3]})", b[1], f"(3 - {b[0]} - {b[2]} - {b[3]})"
neither = f"(1 - {b[1]})"
POINTS = [{"x": 0.0, "to": 1.0}, {"x": 20.0, "to": 5.0}, {"x": 40.0, "to": 3.0}]
TABLE = {"value": POINTS, "type": {"type": "array", "items": {"type": "record", "name": "Point", "fields": [{"name": "x", "type": "double"}, {"name": "to", "type": "double"}]}}}
line = "CASE WHEN x <= 20 THEN 1 + 4 * x / 20 ELSE 5 - 2 * (x - 20) / 20 END"
family("fn_linear", "lineitem", LINE, Q, [
    ("la_map", got({"la.map": [M, fn("double", {"*": ["v", 3.0]}, v="double")]}, 0, 0), "3 * x", 6),
    ("la_zipmap", got({"la.zipmap": [M, M, SQ]}, 0, 1), "0", 6),
    ("la_add", got({"la.add": [M, M]}, 0, 0), "2 * x", 6),
    ("la_sub", got({"la.sub": [M, matrix(row(1.0, 2.0), row(3.0, 4.0))]}, 1, 0), "t - 3", 6),
    ("la_dot", got({"la.dot": [M, M]}, 0, 1), "x * y + 2 * y", 6),
    ("la_dot_vector", got({"la.dot": [M, row(2.0, 3.0)]}, 1), "2 * t + 6", 6),
    ("la_transpose", got({"la.transpose": [M]}, 1, 0), "y", 6),
    ("la_inverse", got({"la.inverse": [M]}, 0, 0), "2 / (2 * x - y * t)", 6),
    ("la_trace", {"la.trace": [M]}, "x + 2", 6),
    ("la_det", {"la.det": [M]}, "2 * x - y * t", 6),
    ("la_symmetric", {"la.symmetric": [M, 0.02]}, "abs(y - t) < 0.02::DOUBLE"),
    ("la_eigen", got({"la.eigenBasis": [matrix(row({"+": ["x", 10.0]}, 0.0), row(0.0, 2.0))]}, 0, 0), "1 / sqrt(x + 10)", 6),
    ("la_truncate", {"a.len": [{"la.truncate": [M, 1]}]}, "CAST(1 AS INTEGER)"),
    ("euclidean", {"metric.euclidean": [ABS, V, W]}, "sqrt(pow(x - 25, 2) + pow(y - 0.05::DOUBLE, 2) + pow(t - 0.04::DOUBLE, 2))", 6),
    ("squared", {"metric.squaredEuclidean": [ABS, V, W]}, "pow(x - 25, 2) + pow(y - 0.05::DOUBLE, 2) + pow(t - 0.04::DOUBLE, 2)", 5),
    ("chebyshev", {"metric.chebyshev": [ABS, V, W]}, "greatest(abs(x - 25), abs(y - 0.05::DOUBLE), abs(t - 0.04::DOUBLE))", 6),
    ("taxicab", {"metric.taxicab": [ABS, V, W]}, "abs(x - 25) + abs(y - 0.05::DOUBLE) + abs(t - 0.04::DOUBLE)", 6),
    ("minkowski", {"metric.minkowski": [ABS, V, W, 3.0]}, "pow(pow(abs(x - 25), 3) + pow(abs(y - 0.05::DOUBLE), 3) + pow(abs(t - 0.04::DOUBLE), 3), 1 / 3.0::DOUBLE)", 5),
    ("matching", {"metric.simpleMatching": [B1, B2]}, f"({both} + {neither}) / 4", 6),
    ("jaccard", {"metric.jaccard": [B1, B2]}, f"{both} / ({both} + {only_x} + {only_y})", 6),
    ("tanimoto", {"metric.tanimoto": [B1, B2]}, f"({both} + {neither}) / ({both} + 2 * ({only_x} + {only_y}) + {neither})", 6),
    ("binary_", {"metric.binarySimilarity": [B1, B2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0]}, f"{both} / 4", 6),
    ("kernel", {"m.kernel.sigmoid": [row("y", "t"), row(1.0, 2.0), 0.5, 0.25]}, "tanh(0.5 * (y + 2 * t) + 0.25)", 6),
    ("nearest", {"interp.nearest": ["x", TABLE]}, "CASE WHEN x <= 10 THEN 1 WHEN x <= 30 THEN 5 ELSE 3 END", 6),
    ("linear", {"interp.linear": ["x", TABLE]}, line, 6),
    ("flat", {"interp.linearFlat": ["x", TABLE]}, f"CASE WHEN x >= 40 THEN 3 ELSE {line} END", 6),
    ("missing", {"impute.defaultOnNull": [{"interp.linearMissing": ["x", TABLE]}, -1.0]}, f"CASE WHEN x > 40 THEN -1 ELSE {line} END", 6),
])

# models
DATA = {"x": ("l_quantity", "l_quantity"), "y": ("l_discount", "l_discount"), "t": ("l_tax", "l_tax"), "n": ("l_linenumber", "l_linenumber"), "r": ("named_struct('q', l_quantity, 'd', case when l_tax < 0.04 then l_discount end)", "l_tax"), "f": ("l_returnflag", "l_returnflag")}
TEST = {"type": "record", "name": "Test", "fields": [{"name": "field", "type": "string"}, {"name": "operator", "type": "string"}, {"name": "value", "type": "double"}]}
WALK = {"type": "record", "name": "Walk", "fields": [*TEST["fields"], *({"name": k, "type": ["Walk", "string"]} for k in ("pass", "fail", "missing"))]}
test = lambda field, op, value, **more: {"field": field, "operator": op, "value": value, **more}
constant = lambda value, kind: {"value": value, "type": kind}
TESTS = {"type": "array", "items": TEST}
TREE = test("q", "<", 20.0, **{"pass": {"string": "low"}, "fail": {"Walk": test("d", ">", 0.05, **{"pass": {"string": "off"}, "fail": {"string": "full"}, "missing": {"string": "unknown"}})}, "missing": {"string": "none"}})
known_d = "(t < 0.04::DOUBLE)"
CLUSTER = {"type": "record", "name": "Group", "fields": [{"name": "center", "type": DOUBLES}, {"name": "id", "type": "string"}]}
GROUPS = constant([{"center": [10.0, 0.02], "id": "a"}, {"center": [30.0, 0.05], "id": "b"}, {"center": [45.0, 0.08], "id": "c"}], {"type": "array", "items": CLUSTER})
XY = row("x", "y")
dist = lambda a, c: f"(pow(x - {a}, 2) + pow(y - {c}::DOUBLE, 2))"
order_ids = f"list_transform(list_sort([{{'v': {dist(10, 0.02)}, 'k': 'a'}}, {{'v': {dist(30, 0.05)}, 'k': 'b'}}, {{'v': {dist(45, 0.08)}, 'k': 'c'}}]), lambda z: z.k)"
POINT_LIST = matrix(row("x", "y"), row("t", 2.0), row(5.0, 1.0))
EUCLID = fn("double", {"metric.simpleEuclidean": ["a", "b"]}, a=DOUBLES, b=DOUBLES)
BOOK = constant([[10.0, 0.02], [30.0, 0.05], [45.0, 0.08]], MATRIX)
NORMAL = constant([{"mean": 25.0, "variance": 100.0}, {"mean": 0.05, "variance": 0.01}], {"type": "array", "items": {"type": "record", "name": "Normal", "fields": [{"name": "mean", "type": "double"}, {"name": "variance", "type": "double"}]}})
LAYERS = constant([{"weights": [[0.1, 2.0], [-0.2, 1.0]], "bias": [0.5, 0.25]}, {"weights": [[1.0, -1.0]], "bias": [0.125]}], {"type": "array", "items": {"type": "record", "name": "Layer", "fields": [{"name": "weights", "type": MATRIX}, {"name": "bias", "type": DOUBLES}]}})
VECTOR = {"type": "array", "items": {"type": "record", "name": "Support", "fields": [{"name": "supVec", "type": DOUBLES}, {"name": "coeff", "type": "double"}]}}
MACHINE = constant({"const": 0.5, "posClass": [{"supVec": [1.0, 2.0], "coeff": 0.3}], "negClass": [{"supVec": [0.5, -1.0], "coeff": -0.2}]}, {"type": "record", "name": "Machine", "fields": [{"name": "const", "type": "double"}, {"name": "posClass", "type": VECTOR}, {"name": "negClass", "type": VECTOR}]})
COVAR = constant({"coeff": [1.0, 2.0], "const": 0.0, "covar": [[1.0, 0.1, 0.2], [0.1, 2.0, 0.3], [0.2, 0.3, 0.5]]}, {"type": "record", "name": "Variance", "fields": [{"name": "coeff", "type": DOUBLES}, {"name": "const", "type": "double"}, {"name": "covar", "type": MATRIX}]})
SEEN = constant([{"x": 0.0, "to": 1.0}, {"x": 20.0, "to": 5.0}], {"type": "array", "items": {"type": "record", "name": "Seen", "fields": [{"name": "x", "type": "double"}, {"name": "to", "type": "double"}]}})
KERNEL = fn("double", {"m.kernel.rbf": ["a", "b", 0.01]}, a=DOUBLES, b=DOUBLES)
k20, kx0, kx20 = "exp(-4.0::DOUBLE)", "exp(-0.01::DOUBLE * x * x)", "exp(-0.01::DOUBLE * (x - 20) * (x - 20))"
COV = constant([[4.0, 0.0], [0.0, 0.25]], MATRIX)
CHI = {"type": "record", "name": "Chi", "fields": [{"name": "chi2", "type": "double"}, {"name": "dof", "type": "int"}]}
CHI_OLD = {"type": "record", "name": "ChiOld", "fields": [{"name": "chi2", "type": "double"}, {"name": "DOF", "type": "int"}]}
chi = {"new": {"chi2": "x", "dof": 3}, "type": CHI}
chi_old = {"new": {"chi2": "x", "DOF": 3}, "type": CHI_OLD}
two = {"new": {"chi2": "x", "dof": 2}, "type": CHI}
two_old = {"new": {"chi2": "x", "DOF": 2}, "type": CHI_OLD}
family("fn_tree", "lineitem", LINE, DATA, [
    ("simple", {"model.tree.simpleTest": ["r", constant(test("q", "<=", 25.0), TEST)]}, "x <= 25"),
    ("missing", {"impute.defaultOnNull": [{"model.tree.missingTest": ["r", constant(test("d", ">", 0.05), TEST)]}, False]}, f"{known_d} AND y > 0.05::DOUBLE"),
    ("compound", {"model.tree.compoundTest": ["r", LIT("and"), constant([test("q", "<=", 25.0), test("q", ">", 10.0)], TESTS), {"fcn": "model.tree.simpleTest"}]}, "x <= 25 AND x > 10"),
    ("surrogate", {"model.tree.surrogateTest": ["r", constant([test("d", ">", 0.05), test("q", ">", 10.0)], TESTS), {"fcn": "model.tree.missingTest"}]}, f"CASE WHEN {known_d} THEN y > 0.05::DOUBLE ELSE x > 10 END"),
    ("walk", {"model.tree.simpleWalk": ["r", constant(test("q", "<", 20.0, **{"pass": {"string": "low"}, "fail": {"string": "high"}}), WALK), {"fcn": "model.tree.simpleTest"}]}, "CASE WHEN x < 20 THEN 'low' ELSE 'high' END"),
    ("missing_walk", {"model.tree.missingWalk": ["r", constant(TREE, WALK), {"fcn": "model.tree.missingTest"}]}, f"CASE WHEN x < 20 THEN 'low' WHEN NOT {known_d} THEN 'unknown' WHEN y > 0.05::DOUBLE THEN 'off' ELSE 'full' END"),
])
family("fn_model", "lineitem", LINE, DATA, [
    ("closest_n", got({"model.cluster.closestN": [2, XY, GROUPS]}, 1, LIT("id")), f"{order_ids}[2]"),
    ("seeds", {"a.len": [{"model.cluster.randomSeeds": [POINT_LIST, 2, fn(CLUSTER, {"new": {"center": "p", "id": {"s.number": ["i"]}}, "type": CLUSTER}, i="int", p=DOUBLES)]}]}, "CAST(2 AS INTEGER)"),
    ("iteration", got({"model.cluster.kmeansIteration": [POINT_LIST, GROUPS, EUCLID, fn(CLUSTER, {"model.cluster.updateMean": ["p", "c", 1.0]}, p=MATRIX, c=CLUSTER)]}, 2, LIT("center"), 0), f"CASE WHEN {order_ids}[1] = 'c' THEN (45 + x) / 2 ELSE 45 END", 6),
    ("update_mean", got({"model.cluster.updateMean": [POINT_LIST, {"attr": GROUPS, "path": [0]}, 3.0]}, LIT("center"), 0), "(30 + x + t + 5) / 6", 6),
    ("mean", got({"model.neighbor.mean": [POINT_LIST]}, 0), "(x + t + 5) / 3", 6),
    ("nearest", got({"model.neighbor.nearestK": [2, XY, BOOK]}, 1, 0), f"CASE {order_ids}[2] WHEN 'a' THEN 10 WHEN 'b' THEN 30 ELSE 45 END", 6),
    ("ball", {"a.len": [{"model.neighbor.ballR": [12.0, XY, BOOK]}]}, f"CAST((sqrt({dist(10, 0.02)}) < 12)::INT + (sqrt({dist(30, 0.05)}) < 12)::INT + (sqrt({dist(45, 0.08)}) < 12)::INT AS INTEGER)"),
    ("gaussian", {"model.naive.gaussian": [XY, NORMAL]}, "-ln(2 * pi() * 100) / 2 - pow(x - 25, 2) / 200 - ln(2 * pi() * 0.01) / 2 - pow(y - 0.05::DOUBLE, 2) / 0.02", 6),
    ("multinomial", {"model.naive.multinomial": [XY, constant([2.0, 6.0], DOUBLES)]}, "x * ln(0.25) + y * ln(0.75)", 6),
    ("bernoulli", {"model.naive.bernoulli": [new(STRINGS, "f"), constant({"A": 0.3, "N": 0.6, "R": 0.2}, {"type": "map", "values": "double"})]}, "CASE f WHEN 'A' THEN ln(0.3) + ln(0.4) + ln(0.8) WHEN 'N' THEN ln(0.7) + ln(0.6) + ln(0.8) ELSE ln(0.7) + ln(0.4) + ln(0.2) END", 6),
    ("layers", got({"model.neural.simpleLayers": [XY, LAYERS, fn("double", {"m.link.tanh": ["v"]}, v="double")]}, 0), "tanh(0.1 * x + 2 * y + 0.5) - tanh(-0.2 * x + y + 0.25) + 0.125", 6),
    ("machine", {"model.svm.score": [XY, MACHINE, fn("double", {"m.kernel.linear": ["a", "b"]}, a=DOUBLES, b=DOUBLES)]}, "0.3 * (x + 2 * y) - 0.2 * (0.5 * x - y) + 0.5", 6),
    ("variance", {"model.reg.linearVariance": [XY, COVAR]}, "x * x + 0.2 * x * y + 0.4 * x + 2 * y * y + 0.6 * y + 0.5", 5),
    ("residual", {"model.reg.residual": ["x", 25.0]}, "x - 25", 6),
    ("pull", {"model.reg.pull": ["x", 25.0, 4.0]}, "(x - 25) / 4", 6),
    ("chi2", got({"model.reg.updateChi2": ["y", chi_old]}, LIT("chi2")), "x + y * y", 6),
    ("reduced", {"model.reg.reducedChi2": [chi_old]}, "x / 3", 6),
    ("chance", {"model.reg.chi2Prob": [two_old]}, "1 - exp(-x / 2)", 6),
    ("test_chi2", got({"stat.test.updateChi2": ["y", chi]}, LIT("dof")), "4", 6),
    ("test_reduced", {"stat.test.reducedChi2": [chi]}, "x / 3", 6),
    ("test_chance", {"stat.test.chi2Prob": [two]}, "1 - exp(-x / 2)", 6),
    ("same", {"stat.test.kolmogorov": [row("x", "y", "t"), row("t", "x", "y")]}, "1", 6),
])
family("fn_solved", "lineitem", LINE, DATA, [
    ("process", {"model.reg.gaussianProcess": ["x", SEEN, None, KERNEL]}, f"({kx0} * (1 - 5 * {k20}) + {kx20} * (5 - {k20})) / (1 - {k20} * {k20})", 6),
    ("mahalanobis", {"model.reg.mahalanobis": [XY, row(25.0, 0.05), COV]}, "sqrt(pow(x - 25, 2) / 4 + pow(y - 0.05::DOUBLE, 2) * 4)", 6),
    ("test_mahalanobis", {"stat.test.mahalanobis": [XY, row(25.0, 0.05), COV]}, "sqrt(pow(x - 25, 2) / 4 + pow(y - 0.05::DOUBLE, 2) * 4)", 6),
])

# online statistics, change detection
SAMPLE = {"s": ("named_struct('count', 10D, 'mean', 20D, 'variance', 4D)", "1"), "e": ("named_struct('mean', 20D, 'variance', 4D)", "1"), "h": ("named_struct('level', 20D, 'trend', 1D)", "1")}
SAMPLE["c"] = ("named_struct('level', 20D, 'trend', 1D, 'cycle', array(1D, 2D, 3D), 'multiplicative', false)", "1")
SAMPLE["b"] = ("named_struct('numbins', 10, 'low', 0D, 'high', 50D, 'values', array_repeat(0D, 10))", "1")
SAMPLE["b2"] = ("named_struct('xnumbins', 5, 'xlow', 0D, 'xhigh', 51D, 'ynumbins', 2, 'ylow', 0D, 'yhigh', 0.2D, 'values', array_repeat(array_repeat(0D, 2), 5))", "1")
SAMPLE["k"] = ("named_struct('values', map('A', 5D))", "1")
SAMPLE["g"] = ("named_struct('numEvents', 3, 'numRuns', 2, 'currentRun', 1, 'longestRun', 2)", "1")
SAMPLE["v"] = ("named_struct('count', 10D, 'mean', array(20D, 0.05D), 'covariance', array(array(4D, 0.1D), array(0.1D, 0.01D)))", "1")
SAMPLE["u"] = ("array(named_struct('x', 10D, 'w', 1D, 'count', 1D, 'mean', 10D, 'variance', 0D), named_struct('x', 30D, 'w', 1D, 'count', 2D, 'mean', 20D, 'variance', 100D))", "1")
SAMPLE |= {"x": DATA["x"], "y": DATA["y"], "n": DATA["n"], "f": DATA["f"]}
shift = "((x - 20) * 2 / 12)"
family("fn_sample", "lineitem", LINE, SAMPLE, [
    ("mean", got({"stat.sample.update": ["x", 2.0, "s"]}, LIT("mean")), f"20 + {shift}", 6),
    ("variance", got({"stat.sample.update": ["x", 2.0, "s"]}, LIT("variance")), f"(40 + 2 * (x - 20) * (x - 20 - {shift})) / 12", 6),
    ("covariance", {"+": [1.0, got({"stat.sample.updateCovariance": [row("x", "y"), 2.0, "v"]}, LIT("covariance"), 0, 1)]}, "1 + (0.1 * 10 + (x - 20) * (y - 0.05::DOUBLE) * 2 * 10 / 12) / 12", 6),
    ("window", got({"stat.sample.updateWindow": ["x", 1.0, "u", 2]}, 1, LIT("variance")), "pow((x - 30) / 2, 2)", 6),
    ("ewma", got({"stat.sample.updateEWMA": ["x", 0.25, "e"]}, LIT("mean")), "20 + 0.25 * (x - 20)", 6),
    ("ewma_variance", got({"stat.sample.updateEWMA": ["x", 0.25, "e"]}, LIT("variance")), "0.75 * (4 + 0.25 * pow(x - 20, 2))", 6),
    ("level", got({"stat.sample.updateHoltWinters": ["x", 0.3, 0.1, "h"]}, LIT("level")), "0.3 * x + 0.7 * 21", 6),
    ("trend", got({"stat.sample.updateHoltWinters": ["x", 0.3, 0.1, "h"]}, LIT("trend")), "0.1 * (0.3 * x + 0.7 * 21 - 20) + 0.9", 6),
    ("cycle", got({"stat.sample.updateHoltWintersPeriodic": ["x", 0.3, 0.1, 0.2, "c"]}, LIT("level")), "0.3 * (x - 2) + 0.7 * 21", 6),
    ("forecast1", {"stat.sample.forecast1HoltWinters": ["h"]}, "21", 6),
    ("forecast", got({"stat.sample.forecastHoltWinters": [3, "h"]}, 2), "23", 6),
    ("histogram", {"a.argmax": [got({"stat.sample.fillHistogram": ["x", 1.0, "b"]}, LIT("values"))]}, "CAST(CASE WHEN x < 50 THEN floor(x / 5) ELSE 0 END AS INTEGER)"),
    ("histogram2d", got({"stat.sample.fillHistogram2d": ["x", "y", 2.5, "b2"]}, LIT("values"), 2, 0), "CASE WHEN floor(x / 51 * 5) = 2 AND y < 0.1::DOUBLE THEN 2.5 ELSE 0 END", 6),
    ("counter", {"a.sum": [{"map.values": [got({"stat.sample.fillCounter": ["f", 2.0, "k"]}, LIT("values"))]}]}, "7", 6),
    ("top", joined({"stat.sample.topN": ["n", ints(9, 4, 2), 3, LESS]}), sql_joined("list_reverse_sort([9, 4, 2, n])[:3]")),
    ("trigger", got({"stat.change.updateTrigger": [{">": ["x", 25]}, "g"]}, LIT("currentRun")), "CAST(CASE WHEN x > 25 THEN 2 ELSE 0 END AS INTEGER)"),
    ("z", {"stat.change.zValue": ["x", "s", False]}, "(x - 20) / 2", 6),
    ("z_unbiased", {"stat.change.zValue": ["x", "s", True]}, "(x - 20) / 2 * sqrt(10.0 / 9)", 6),
])

# distributions
PROB = {"x": ("l_quantity / 10", "l_quantity / 10"), "p": ("l_quantity / 51", "l_quantity / 51"), "k": ("l_linenumber", "l_linenumber"), "y": ("l_discount", "l_discount")}
P = lambda name, *a: {f"prob.dist.{name}": list(a)}
lg = "lgamma"
choose = lambda n, k: f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
sums = lambda term: f"list_sum(list_transform(range(0, k + 1), lambda j: {term}))"
error_function = lambda v: f"(2 / sqrt(pi()) * list_sum(list_transform(range(0, 12), lambda j: pow(-1, j) * pow({v}, 2 * j + 1) / (factorial(CAST(j AS INTEGER)) * (2 * j + 1)))))"
family("fn_density", "lineitem", LINE, PROB, [
    ("erf", {"m.special.erf": ["y"]}, error_function("y"), 6),
    ("erfc", {"m.special.erfc": ["y"]}, f"1 - {error_function('y')}", 6),
    ("erfc_tail", {"*": [{"m.special.erfc": [6.0]}, 1e17]}, "2.1519736712498913", 6),
    ("probit", {"m.link.probit": ["y"]}, f"0.5 + 0.5 * {error_function('(y / sqrt(2))')}", 6),
    ("gaussian", P("gaussianLL", "x", 2.0, 1.5), "-pow((x - 2) / 1.5, 2) / 2 - ln(1.5 * sqrt(2 * pi()))", 6),
    ("exponential", P("exponentialPDF", "x", 1.5), "1.5 * exp(-1.5 * x)", 6),
    ("chi2", P("chi2PDF", "x", 3), "sqrt(x) * exp(-x / 2) / (pow(2, 1.5) * gamma(1.5))", 6),
    ("poisson", P("poissonPDF", "k", 2.5), "pow(2.5, k) * exp(-2.5) / factorial(k)", 6),
    ("gamma", P("gammaPDF", "x", 2.0, 1.5), "x * exp(-x / 1.5) / 2.25", 6),
    ("beta", P("betaPDF", "p", 2.0, 3.0), "12 * p * (1 - p) * (1 - p)", 6),
    ("cauchy", P("cauchyPDF", "x", 1.0, 2.0), "1 / (pi() * 2 * (1 + pow((x - 1) / 2, 2)))", 6),
    ("f", P("fPDF", "x", 2, 4), "pow(1 + x / 2, -3)", 6),
    ("lognormal", P("lognormalPDF", "x", 0.5, 1.5), "exp(-pow((ln(x) - 0.5) / 1.5, 2) / 2) / (x * 1.5 * sqrt(2 * pi()))", 6),
    ("t", P("tPDF", "x", 2), "pow(2 + x * x, -1.5)", 6),
    ("binomial", P("binomialPDF", "k", 10, 0.3), f"{choose('10', 'k')} * pow(0.3, k) * pow(0.7, 10 - k)", 6),
    ("uniform", P("uniformPDF", "x", 1.0, 3.0), "CASE WHEN x BETWEEN 1 AND 3 THEN 0.5 ELSE 0 END", 6),
    ("geometric", P("geometricPDF", "k", 0.3), "0.3 * pow(0.7, k)", 6),
    ("hypergeometric", P("hypergeometricPDF", "k", 8, 12, 9), f"{choose('8', 'k')} * {choose('12', '(9 - k)')} / {choose('20', '9')}", 6),
    ("weibull", P("weibullPDF", "x", 1.5, 2.0), "0.75 * pow(x / 2, 0.5) * exp(-pow(x / 2, 1.5))", 6),
    ("negative", P("negativeBinomialPDF", "k", 3, 0.4), f"{choose('(k + 2)', 'k')} * pow(0.4, 3) * pow(0.6, k)", 6),
])
family("fn_cumulative", "lineitem", LINE, PROB, [
    ("gaussian", P("gaussianCDF", {"+": ["y", 2.0]}, 2.0, 1.0), f"0.5 + 0.5 * {error_function('(y / sqrt(2))')}", 6),
    ("exponential", P("exponentialCDF", "x", 1.5), "1 - exp(-1.5 * x)", 6),
    ("chi2", P("chi2CDF", "x", 4), "1 - exp(-x / 2) * (1 + x / 2)", 6),
    ("poisson", P("poissonCDF", "k", 2.5), sums("pow(2.5, j) * exp(-2.5) / factorial(CAST(j AS INTEGER))"), 6),
    ("gamma", P("gammaCDF", "x", 2.0, 1.5), "1 - exp(-x / 1.5) * (1 + x / 1.5)", 6),
    ("beta", P("betaCDF", "p", 2.0, 3.0), "p * p * (6 - 8 * p + 3 * p * p)", 6),
    ("cauchy", P("cauchyCDF", "x", 1.0, 2.0), "0.5 + atan((x - 1) / 2) / pi()", 6),
    ("f", P("fCDF", "x", 2, 4), "1 - pow(1 + x / 2, -2)", 6),
    ("lognormal", P("lognormalCDF", {"m.exp": [{"+": ["y", 0.5]}]}, 0.5, 1.0), f"0.5 + 0.5 * {error_function('(y / sqrt(2))')}", 6),
    ("t", P("tCDF", "x", 2), "0.5 + x / (2 * sqrt(2 + x * x))", 6),
    ("binomial", P("binomialCDF", "k", 10, 0.3), sums(f"{choose('10', 'j')} * pow(0.3, j) * pow(0.7, 10 - j)"), 6),
    ("uniform", P("uniformCDF", "x", 1.0, 3.0), "least(greatest((x - 1) / 2, 0), 1)", 6),
    ("geometric", P("geometricCDF", "k", 0.3), "1 - pow(0.7, k + 1)", 6),
    ("hypergeometric", P("hypergeometricCDF", "k", 8, 12, 9), sums(f"{choose('8', 'j')} * {choose('12', '(9 - j)')} / {choose('20', '9')}"), 6),
    ("weibull", P("weibullCDF", "x", 1.5, 2.0), "1 - exp(-pow(x / 2, 1.5))", 6),
    ("negative", P("negativeBinomialCDF", "k", 3, 0.4), sums(f"{choose('(j + 2)', 'j')} * pow(0.4, 3) * pow(0.6, j)"), 6),
])


def inverts(name, *a):
    """The quantile is the smallest whole number whose distribution function reaches p."""
    q = P(f"{name}QF", "p", *a)
    return {"&&": [{">=": [{"+": [P(f"{name}CDF", q, *a), 1e-9]}, "p"]}, {"<": [{"-": [P(f"{name}CDF", {"-": [q, 1.0]}, *a), 1e-9]}, "p"]}]}


family("fn_quantile", "lineitem", LINE, PROB, [
    ("gaussian", P("gaussianCDF", P("gaussianQF", "p", 2.0, 1.0), 2.0, 1.0), "p", 6),
    ("exponential", P("exponentialQF", "p", 1.5), "-ln(1 - p) / 1.5", 6),
    ("chi2", P("chi2QF", "p", 2), "-2 * ln(1 - p)", 6),
    ("poisson", inverts("poisson", 2.5), "true"),
    ("gamma", P("gammaQF", "p", 1.0, 1.5), "-1.5 * ln(1 - p)", 6),
    ("beta", P("betaQF", "p", 1.0, 3.0), "1 - pow(1 - p, 1 / 3.0::DOUBLE)", 6),
    ("cauchy", P("cauchyQF", "p", 1.0, 2.0), "1 + 2 * tan(pi() * (p - 0.5))", 6),
    ("f", P("fQF", "p", 2, 4), "2 * (pow(1 - p, -0.5) - 1)", 6),
    ("lognormal", P("lognormalCDF", P("lognormalQF", "p", 0.5, 1.0), 0.5, 1.0), "p", 6),
    ("t", P("tQF", "p", 2), "(2 * p - 1) / sqrt(2 * p * (1 - p))", 6),
    ("binomial", inverts("binomial", 10, 0.3), "true"),
    ("uniform", P("uniformQF", "p", 1.0, 3.0), "1 + 2 * p", 6),
    ("geometric", inverts("geometric", 0.3), "true"),
    ("hypergeometric", inverts("hypergeometric", 8, 12, 9), "true"),
    ("weibull", P("weibullQF", "p", 1.5, 2.0), "2 * pow(-ln(1 - p), 1 / 1.5::DOUBLE)", 6),
    ("negative", inverts("negativeBinomial", 3, 0.4), "true"),
])

# random values, by what every draw must satisfy; enumerations and fixed bytes
POOL = ints(3, 5, 7, 9)
within = lambda draw, low, high: {"do": [{"let": {"drawn": draw}}, {"&&": [{">=": ["drawn", low]}, {"<": ["drawn", high]}]}]}
COLOUR = {"type": "enum", "name": "Colour", "symbols": ["red", "green", "blue"]}
FOUR = {"type": "fixed", "name": "Four", "size": 4}
family("fn_random", "lineitem", LINE, {"n": DATA["n"]}, [
    ("int_", within({"rand.int": [3, 9]}, 3, 9), "true"),
    ("long_", within({"rand.long": [{"long": 3}, {"long": 9}]}, 3, 9), "true"),
    ("float_", within({"rand.float": [1.0, 2.0]}, 1.0, 2.0), "true"),
    ("double_", within({"rand.double": [1.0, 2.0]}, 1.0, 2.0), "true"),
    ("choice", within({"rand.choice": [POOL]}, 3, 10), "true"),
    ("choices", {"a.subset": [{"rand.choices": ["n", POOL]}, POOL]}, "true"),
    ("n_choices", {"a.len": [{"rand.choices": ["n", POOL]}]}, "CAST(n AS INTEGER)"),
    ("sample", {"a.len": [{"a.distinct": [{"rand.sample": [3, POOL]}]}]}, "CAST(3 AS INTEGER)"),
    ("histogram", within({"rand.histogram": [row(0.0, 1.0, 2.0, 0.0)]}, 1, 3), "true"),
    ("string_", {"s.len": [{"rand.string": ["n"]}]}, "CAST(n AS INTEGER)"),
    ("letters", {"re.contains": [{"rand.string": [12, LIT("xyz")]}, LIT("^[xyz]{12}$")]}, "true"),
    ("bytes_", {"bytes.len": [{"rand.bytes": ["n"]}]}, "CAST(n AS INTEGER)"),
    ("uuid_", {"s.len": [{"rand.uuid": []}]}, "CAST(36 AS INTEGER)"),
    ("uuid4", {"re.contains": [{"rand.uuid4": []}, LIT("^[0-9a-f-]{14}4[0-9a-f-]{21}$")]}, "true"),
    ("gaussian", {"impute.isnum": [{"rand.gaussian": [0.0, 1.0]}]}, "true"),
    ("symbol", {"enum.toString": [constant("green", COLOUR)]}, "'green'"),
    ("place", {"enum.toInt": [constant("green", COLOUR)]}, "CAST(1 AS INTEGER)"),
    ("symbols", {"enum.numSymbols": [constant("green", COLOUR)]}, "CAST(3 AS INTEGER)"),
    ("fixed_", {"bytes.len": [{"fixed.toBytes": [constant("abcd", FOUR)]}]}, "CAST(4 AS INTEGER)"),
    ("filled", {"bytes.decodeAscii": [{"fixed.toBytes": [{"fixed.fromBytes": [constant("abcd", FOUR), UTF8(LIT("xy"))]}]}]}, "'xycd'"),
])
