"""Queries of the string and math functions, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import numeric as M
from lumenframe.functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def string(name: str, value: Callable[[Column, Column], Column], sql: str, customer: bool = False) -> None:
    """value of o_orderpriority and c_name, one of which the table has."""
    table, key = ("customer", "c_custkey") if customer else ("orders", "o_orderkey")

    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = spark.read.parquet(f"{sf}/{table}.parquet")
        return df.select(F.col(key).alias("k"), value(F.col(P), F.col(C)).alias("v"))

    QUERIES[f"fn_{name}"] = query
    SQL[f"fn_{name}"] = f"select {key} as k, {sql} as v from {table}"


lit = F.lit


P, C = "o_orderpriority", "c_name"
string("to_lower", lambda p, n: F.lower(p), f"lower({P})")
string("to_upper", lambda p, n: F.upper(n), f"upper({C})", True)
string("iequals", lambda p, n: T.iequals(p, lit("1-urgent")), f"lower({P}) = '1-urgent'")
string("iless", lambda p, n: T.iless(p, lit("3-Z")), f"lower({P}) < '3-z'")
string("starts_with", lambda p, n: T.starts_with(p, lit("1-")), f"starts_with({P}, '1-')")
string("istarts_with", lambda p, n: T.istarts_with(n, lit("CUST")), f"starts_with(lower({C}), 'cust')", True)
string("ends_with", lambda p, n: T.ends_with(p, lit("GH")), f"suffix({P}, 'GH')")
string("iends_with", lambda p, n: T.iends_with(p, lit("gh")), f"suffix(lower({P}), 'gh')")
string("find", lambda p, n: T.find(p, lit("I")), f"cast(strpos({P}, 'I') - 1 as int)")
string("ifind", lambda p, n: T.ifind(p, lit("i")), f"cast(strpos(lower({P}), 'i') - 1 as int)")
string("rfind", lambda p, n: T.rfind(n, lit("0")), f"cast(case when strpos(reverse({C}), '0') = 0 then -1 else length({C}) - strpos(reverse({C}), '0') end as int)", True)
string("irfind", lambda p, n: T.irfind(n, lit("ER")), f"cast(case when strpos(reverse(lower({C})), 're') = 0 then -1 else length({C}) - strpos(reverse(lower({C})), 're') - 1 end as int)", True)
string("contains", lambda p, n: T.contains(p, lit("HIGH")), f"contains({P}, 'HIGH')")
string("icontains", lambda p, n: T.icontains(p, lit("high")), f"contains(lower({P}), 'high')")
string("contains_any_char", lambda p, n: T.contains_any_char(n, "123"), f"regexp_matches({C}, '[123]')", True)
string("strip", lambda p, n: T.strip(F.concat(lit("  "), n, lit(" \t"))), f"trim('  ' || {C} || ' ' || chr(9), ' ' || chr(9))", True)
string("lstrip", lambda p, n: T.lstrip(n, "Cus"), f"ltrim({C}, 'Cus')", True)
string("rstrip", lambda p, n: T.rstrip(n, "0123"), f"rtrim({C}, '0123')", True)
string("split", lambda p, n: F.get(T.split(p, "-", 1), 1), f"split_part({P}, '-', 2)", False)
string("concat", lambda p, n: F.concat(p, lit("/"), F.col("o_orderstatus")), f"{P} || '/' || o_orderstatus")
string("repeat", lambda p, n: F.repeat(F.col("o_orderstatus"), 3), "repeat(o_orderstatus, 3)")
string("replace", lambda p, n: F.replace(p, lit("-"), lit("::")), f"replace({P}, '-', '::')")
string("stoi", lambda p, n: T.stoi(p), f"cast(regexp_extract({P}, '^([0-9]+)', 1) as int)")
string("stof", lambda p, n: T.stof(F.concat(p.substr(1, 1), lit(".25x"))), f"cast({P}[1] || '.25' as double)")
string("string_is_int", lambda p, n: T.string_is_int(F.substring_index(n, "#", -1)), f"regexp_full_match(split_part({C}, '#', 2), '[0-9]+')", True)
string("string_is_float", lambda p, n: T.string_is_float(F.concat(p.substr(1, 1), F.when(F.col("o_orderkey") % 2 == 0, ".5e3").otherwise("x5"))), "o_orderkey % 2 = 0")
string("parse_word", lambda p, n: T.parse_word(n), f"regexp_extract({C}, '^([A-Za-z]+)', 1)", True)
string("parse_identifier", lambda p, n: T.parse_identifier(n), f"regexp_extract({C}, '^([A-Za-z_][A-Za-z0-9_]*)', 1)", True)
string("parse_until", lambda p, n: T.parse_until(n, "#"), f"split_part({C}, '#', 1)", True)
string("parse_while", lambda p, n: T.parse_while(p, "0-9"), f"regexp_extract({P}, '^([0-9]*)', 1)")
string("parse_line", lambda p, n: T.parse_line(F.concat(n, lit("\nmore"))), C, True)
string("escape_chars", lambda p, n: T.escape_chars(F.concat(n, lit('\n"'))), f"{C} || '\\n\\\"'", True)
string("unescape_chars", lambda p, n: T.unescape_chars(T.escape_chars(F.concat(n, lit('\t\\n"')))), f"{C} || chr(9) || '\\n\"'", True)
string("base64_encode", lambda p, n: F.base64(n.cast("binary")), f"base64(encode({C}))", True)
string("sha1", lambda p, n: F.sha1(n.cast("binary")), f"sha1({C})", True)
string("utf8_to_unicode", lambda p, n: F.array_join(T.utf8_to_unicode(F.concat(n, lit("é"))).cast("array<string>"), ","), f"array_to_string(list_transform(string_split({C} || 'é', ''), lambda x: unicode(x)), ',')", True)
string("parse_char", lambda p, n: F.concat_ws("|", T.parse_char(F.concat(lit("  "), p), "2")["found"].cast("string"), T.parse_char(p, "1")["rest"]), f"cast({P}[1] = '2' as varchar) || '|' || case when {P}[1] = '1' then substr({P}, 2) else {P} end")
string("parse_prefix", lambda p, n: T.parse_prefix(n, "Cust")["rest"], f"substr({C}, 5)", True)
string("parse_int", lambda p, n: T.parse_int(F.substring_index(n, "#", -1))["value"] + F.char_length(T.parse_int(F.concat(lit(" -12x"), n))["rest"]), f"cast(split_part({C}, '#', 2) as int) + length({C}) + 1", True)
string("parse_float", lambda p, n: T.parse_float(F.concat(lit(" -"), p.substr(1, 1), lit(".5e1,"), p))["value"], f"-(cast({P}[1] as double) + 0.5) * 10")
string("stod", lambda p, n: T.stod(F.concat(p.substr(1, 1), lit(".25x"))) + T.stod(lit("none")), f"cast({P}[1] || '.25' as double)")
string("parse_string", lambda p, n: F.concat_ws("|", T.parse_string(F.concat(lit(' "'), n, lit('" rest')))["value"], T.parse_string(F.concat(lit("one two "), n))["rest"]), f"{C} || '| two ' || {C}", True)
string("parse_nested", lambda p, n: F.concat_ws("|", *[T.parse_nested(F.concat(lit("(a[b](c)"), n, lit(") tail)")))[k] for k in ("value", "rest")]), f"'(a[b](c)' || {C} || ')| tail)'", True)
MEM = "cast(trunc(o_totalprice * 10) as bigint)"
string("memformat", lambda p, n: T.memformat((F.col("o_totalprice") * 10).cast("long")), f"case when {MEM} >= 1048576 then printf('%.1f MB', floor({MEM} / 1048576.0 * 10 + 0.5) / 10) else printf('%.1f KB', floor({MEM} / 1024.0 * 10 + 0.5) / 10) end")
string("wordwrap", lambda p, n: T.wordwrap(F.replace(n, lit("#"), lit(" of number ")), 12), f"'Customer of' || chr(10) || 'number' || case when length(split_part({C}, '#', 2)) + 7 > 12 then chr(10) else ' ' end || split_part({C}, '#', 2)", True)

# Arguments of the math functions: u in 0 to 1, x on both sides of 0, i integers.


def _arguments() -> tuple[Column, Column, Column]:
    return (F.col("l_discount") + F.col("l_tax")).cast("double") / 0.2, F.col("l_quantity").cast("double") / 10 - 2.5, F.col("l_partkey")


U, X, I = "((l_discount + l_tax)::double / 0.2)", "(l_quantity::double / 10 - 2.5)", "l_partkey"

EXACT = ("ispow2", "ceil2", "floor2", "round_to_multiple", "safe_mod", "ifloor", "quantize_u8", "quantize_s16")


def math(name: str, value: Callable[[Column, Column, Column], Column], sql: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = spark.read.parquet(f"{sf}/lineitem.parquet")
        v = value(*_arguments())
        return df.select("l_orderkey", "l_linenumber", (v if exact else F.round(v, 6) + 0.0).alias("v"))

    exact = name in EXACT
    QUERIES[f"fn_{name}"] = query
    SQL[f"fn_{name}"] = f"select l_orderkey, l_linenumber, {sql if exact else f'round({sql}, 6) + 0.0'} as v from lineitem"


math("ispow2", lambda u, x, i: M.ispow2(i), f"({I} & ({I} - 1)) = 0")
math("ceil2", lambda u, x, i: M.ceil2(i), f"cast(pow(2, ceil(log2(greatest({I}, 1)))) as bigint)")
math("floor2", lambda u, x, i: M.floor2(i), f"case when {I} < 1 then 0 else cast(pow(2, floor(log2(greatest({I}, 1)))) as bigint) end")
math("round_to_multiple", lambda u, x, i: M.round_to_multiple(i, 16), f"cast(ceil({I} / 16.0) * 16 as bigint)")
math("safe_mod", lambda u, x, i: M.safe_mod(i, F.col("l_suppkey") % 5), f"case when l_suppkey % 5 = 0 then 0 else {I} % (l_suppkey % 5) end")
math("safe_fmod", lambda u, x, i: M.safe_fmod(x, F.round(u)), f"case when round({U}) = 0 then 0 else {X} - trunc({X} / round({U})) * round({U}) end")
math("clamp", lambda u, x, i: M.clamp(x, -1.0, 1.0), f"least(greatest({X}, -1.0), 1.0)")
math("madd", lambda u, x, i: x * u + 0.5, f"{X} * {U} + 0.5")
math("msub", lambda u, x, i: x * u - 0.5, f"{X} * {U} - 0.5")
math("lerp", lambda u, x, i: M.lerp(x, lit(2.0), u), f"{X} * (1 - {U}) + 2 * {U}")
math("bilerp", lambda u, x, i: M.bilerp(x, lit(1.0), lit(2.0), x * x, u, lit(0.25)), f"({X} * (1 - {U}) + {U}) * 0.75 + (2 * (1 - {U}) + {X} * {X} * {U}) * 0.25")
math("trilerp", lambda u, x, i: M.trilerp([x, lit(1.0), lit(2.0), x, x, x, x, x], u, lit(0.25), lit(0.5)), f"0.5 * (({X} * (1 - {U}) + {U}) * 0.75 + (2 * (1 - {U}) + {X} * {U}) * 0.25) + 0.5 * {X}")
math("ifloor", lambda u, x, i: F.floor(x), f"cast(floor({X}) as bigint)")
math("floorfrac", lambda u, x, i: M.floorfrac(x)[1], f"{X} - floor({X})")
math("radians", lambda u, x, i: F.radians(x), f"radians({X})")
math("degrees", lambda u, x, i: F.degrees(x), f"degrees({X})")
math("sign", lambda u, x, i: M.sign(x), f"case when {X} < 0 then -1.0 else 1.0 end")
math("safe_sqrt", lambda u, x, i: M.safe_sqrt(x), f"sqrt(greatest({X}, 0.0))")
math("safe_inversesqrt", lambda u, x, i: M.safe_inversesqrt(x), f"case when {X} > 0 then 1 / sqrt(greatest({X}, 1e-30)) else 0.0 end")
math("safe_asin", lambda u, x, i: M.safe_asin(x), f"asin(least(greatest({X}, -1.0), 1.0))")
math("safe_acos", lambda u, x, i: M.safe_acos(x), f"acos(least(greatest({X}, -1.0), 1.0))")
math("safe_log", lambda u, x, i: M.safe_log(x + 3), f"ln(greatest({X} + 3, {M.TINY}))")
math("safe_log2", lambda u, x, i: M.safe_log2(x), f"log2(greatest({X}, {M.TINY}))")
math("safe_log10", lambda u, x, i: M.safe_log10(x), f"log10(greatest({X}, {M.TINY}))")
math("safe_logb", lambda u, x, i: M.safe_logb(x + 2.47), f"case when {X} + 2.47 = 0 then -126.0 else floor(log2(abs({X} + 2.47))) end")
math("safe_pow", lambda u, x, i: M.safe_pow(x, lit(2.0)), f"case when {X} = 0 then 0.0 else pow({X}, 2.0) end")
math("interpolate_linear", lambda u, x, i: M.interpolate_linear(u, [0.0, 1.0, 0.5]), f"case when {U} <= 0.5 then greatest({U}, 0.0) * 2 else 1.0 - (least({U}, 1.0) * 2 - 1) * 0.5 end")
math("quantize_u8", lambda u, x, i: M.quantize(u, 8), f"cast(floor(least(greatest({U} * 255.0 + 0.5, 0.0), 255.0)) as bigint)")
math("quantize_s16", lambda u, x, i: M.quantize(x / 3, 16, True), f"cast(trunc(least(greatest({X} / 3 * 32767.0 + case when {X} < 0 then -0.5 else 0.5 end, -32768.0), 32767.0)) as bigint)")
for _name, _f, _s in (
    ("sin", lambda u, x, i: F.sin(x), f"sin({X})"), ("cos", lambda u, x, i: F.cos(x), f"cos({X})"), ("tan", lambda u, x, i: F.tan(u), f"tan({U})"), ("acos", lambda u, x, i: F.acos(u - 0.5), f"acos({U} - 0.5)"), ("asin", lambda u, x, i: F.asin(u - 0.5), f"asin({U} - 0.5)"),
    ("atan", lambda u, x, i: F.atan(x), f"atan({X})"), ("atan2", lambda u, x, i: F.atan2(x, u + 1), f"atan2({X}, {U} + 1)"), ("log", lambda u, x, i: F.log(u + 1), f"ln({U} + 1)"), ("log2", lambda u, x, i: F.log2(u + 1), f"log2({U} + 1)"), ("log10", lambda u, x, i: F.log10(u + 1), f"log10({U} + 1)"),
    ("log1p", lambda u, x, i: F.log1p(u), f"ln(1 + {U})"), ("exp", lambda u, x, i: F.exp(x), f"exp({X})"), ("exp2", lambda u, x, i: F.pow(lit(2.0), x), f"pow(2.0, {X})"), ("exp10", lambda u, x, i: F.pow(lit(10.0), u), f"pow(10.0, {U})"), ("expm1", lambda u, x, i: F.expm1(u), f"exp({U}) - 1"),
    ("sinh", lambda u, x, i: F.sinh(x), f"sinh({X})"), ("cosh", lambda u, x, i: F.cosh(x), f"cosh({X})"), ("tanh", lambda u, x, i: F.tanh(x), f"tanh({X})"), ("cbrt", lambda u, x, i: F.cbrt(u + 1), f"cbrt({U} + 1)"), ("rint", lambda u, x, i: F.rint(x + 0.05), f"round({X} + 0.05)"), ("neg", lambda u, x, i: 0 - x, f"0 - {X}"),
    ("sinpi", lambda u, x, i: F.sin(3.141592653589793 * u), f"sin(pi() * {U})"), ("cospi", lambda u, x, i: F.cos(3.141592653589793 * u), f"cos(pi() * {U})"), ("pow_pos", lambda u, x, i: F.pow(u + 1, x), f"pow({U} + 1, {X})"), ("logb", lambda u, x, i: F.floor(F.log2(u + 1.01)).cast("double"), f"floor(log2({U} + 1.01))"),
):
    math(f"fast_{_name}", _f, _s)
math("sincos", lambda u, x, i: M.sincos(x)["sin"] * 2 + M.sincos(x)["cos"], f"sin({X}) * 2 + cos({X})")
math("fast_safe_pow", lambda u, x, i: M.fast_safe_pow(x, F.floor(u * 4).cast("double")) + M.fast_safe_pow(x, u), f"(case when floor({U} * 4) = 0 then 1.0 when {X} = 0 then 0.0 else pow({X}, floor({U} * 4)) end) + (case when {U} = 0 then 1.0 when {X} = 0 then 0.0 when {X} > 0 then pow(abs({X}), {U}) when {U} = 1 then {X} else 0.0 end)")
_T = f"(1 / (1 + 0.3275911 * abs({X})))"
_ERF = f"(sign({X}) * (1 - {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{X} * {X})))"
math("fast_erf", lambda u, x, i: M.fast_erf(x), _ERF)
math("fast_erfc", lambda u, x, i: M.fast_erfc(x), f"1 - {_ERF}")
_LN = f"ln(1 - pow(least(greatest({U} - 0.5, -0.99999994), 0.99999994), 2.0))"
math("fast_ierf", lambda u, x, i: M.fast_ierf(u - 0.5), f"sign({U} - 0.5) * sqrt(sqrt(pow(2 / (pi() * 0.147) + {_LN} / 2, 2) - {_LN} / 0.147) - (2 / (pi() * 0.147) + {_LN} / 2))")
