"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import dates as D
from larkspur.functions import logic as L
from larkspur.functions import numbers as N
from larkspur.functions import text as S
from larkspur.plans import plan
from larkspur.sources.tables import Tables


@plan("select p_partkey, ascii(p_name) as a, strlen(p_name)::int as b, length(p_name)::int as n, p_name || '/' || p_brand as c, upper(p_name) as u, lower(p_brand) as l, reverse(p_name) as r, left(p_name, 3) as lf, right(p_name, 2) as rt from part")
def text_basic(t: Tables) -> DataFrame:
    n = "p_name"
    return t.part.select("p_partkey", S.ascii_code(n).alias("a"), S.byte_length(n).alias("b"), S.char_length(n).alias("n"), S.concat(n, F.lit("/"), "p_brand").alias("c"), S.upper(n).alias("u"), S.lower("p_brand").alias("l"), S.reverse(n).alias("r"), S.left(n, 3).alias("lf"), S.right(n, 2).alias("rt"))


_T = "(values (1, 'abcabc', 'b'), (2, '', 'x'), (3, null, 'a'), (4, 'Ünï', null)) v(id, s, x)"


def _t(t: Tables) -> DataFrame:
    return t.rows([(1, "abcabc", "b"), (2, "", "x"), (3, None, "a"), (4, "Ünï", None)], "id int, s string, x string")


@plan(f"""select id, s || x as c, case when s is null and x is null then null else coalesce(s, '') || coalesce(x, '') end as o, concat_ws('-', s, x, 'z') as w, case when x is not null then concat_ws(x, s, 'z') end as wc,
case id when 1 then 'one' when 2 then 'two' end as e, strlen(s)::int as bytes, case when s = '' then 0 else case s when 'abcabc' then 97 when 'Ünï' then 195 end end as a from {_T}""")
def text_concat_forms(t: Tables) -> DataFrame:
    return _t(t).select("id", S.concat("s", "x").alias("c"), S.concat_oracle("s", "x").alias("o"), S.concat_ws("-", "s", "x", F.lit("z")).alias("w"), S.concat_ws(F.col("x"), "s", F.lit("z")).alias("wc"), S.elt("id", F.lit("one"), F.lit("two")).alias("e"), S.byte_length("s").alias("bytes"), S.ascii_code("s").alias("a"))


@plan(f"""select id, case when s = '' then '' else lpad(s, 9, 'xy') end as l, case when s = '' then '' else rpad(s, 4, '*') end as r, case when length(s) >= 0 then repeat(s, 2) end as r2, null::varchar as r0, case when id > 1 then repeat(' ', id - 1) end as sp,
replace(s, 'bc', '-') as rep, nullif(replace(s, coalesce(x, ''), ''), '') as ro, case when s is null then null else instr(s, 'ca')::int end as i from {_T}""")
def text_pad_repeat(t: Tables) -> DataFrame:
    return _t(t).select("id", S.lpad("s", 9, "xy").alias("l"), S.rpad("s", 4, "*").alias("r"), S.repeat("s", 2).alias("r2"), S.repeat("s", 0).alias("r0"), S.space(F.col("id") - 1).alias("sp"), S.replace("s", F.lit("bc"), F.lit("-")).alias("rep"), S.replace_oracle("s", "x", F.lit(None)).alias("ro"), S.instr("s", F.lit("ca")).alias("i"))


@plan("""select p_partkey, '' as z, case when length(p_name) >= 4 then substr(p_name, length(p_name) - 3) else '' end as neg, substr(p_name, 3, 4) as mid, '' as none, split_part(p_name, ' ', 1) as first_word, regexp_extract(p_name, '[^ ]*$') as last_word,
instr(p_name, 'e')::int as at, case when instr(substr(p_name, 4), 'e') > 0 then instr(substr(p_name, 4), 'e') + 3 else 0 end::int as at4, substr(p_name, 1, 1) || 'XX' || substr(p_name, 4) as ins from part""")
def text_substr_locate(t: Tables) -> DataFrame:
    n = "p_name"
    return t.part.select("p_partkey", S.substr(n, 0, 2).alias("z"), S.substr(n, -4).alias("neg"), S.substr(n, 3, 4).alias("mid"), S.substr(n, 2, 0).alias("none"), S.substring_index(n, " ", 1).alias("first_word"), S.substring_index(n, " ", -1).alias("last_word"), S.instr(n, F.lit("e")).alias("at"), S.instr(n, F.lit("e"), 4).alias("at4"), S.insert(n, 2, 2, F.lit("XX")).alias("ins"))


@plan("""select * from (values (1, 'xyabxyxy', 'abxyxy', 'xyab', 'ab', 'xyabxyxy'), (2, ' q ', ' q ', ' q ', ' q ', 'q'), (3, 'xyxy', '', '', '', 'xyxy')) v(id, s, l, r, b, plain)""")
def text_trim(t: Tables) -> DataFrame:
    rows = t.rows([(1, "xyabxyxy"), (2, " q "), (3, "xyxy")], "id int, s string")
    return rows.select("id", "s", S.ltrim("s", "xy").alias("l"), S.rtrim("s", "xy").alias("r"), S.trim("s", "xy").alias("b"), S.trim("s").alias("plain"))


@plan("select * from (values (1, 'ab'::varchar, 'ab  '::varchar, '  ab'::varchar), (2, null, null, null)) v(id, t, l, r)")
def text_trim_oracle(t: Tables) -> DataFrame:
    rows = t.rows([(1, "  ab  "), (2, "   ")], "id int, s string")
    return rows.select("id", S.trim_oracle("s").alias("t"), S.ltrim_oracle("s").alias("l"), S.rtrim_oracle("s").alias("r"))


@plan("""select * from (values (1, '''it\\''s''', 2, -1, 0), (2, 'NULL', 0, null, null)) v(id, q, f, c, ci)""")
def text_quote_find_compare(t: Tables) -> DataFrame:
    rows = t.rows([(1, "it's", "b", "a", "B "), (2, None, "a,b", None, "x")], "id int, s string, k string, a string, b string")
    return rows.select("id", S.quote("s").alias("q"), S.find_in_set("k", F.lit("a,b,c")).alias("f"), S.strcmp("a", F.lit("b ")).alias("c"), S.strcmp(F.when(F.col("a").isNotNull(), "b"), "b", ignore_case=True).alias("ci"))


@plan("select s_suppkey, printf('%X', s_suppkey) as h, upper(hex(s_name)) as hs, s_name as back, to_base(s_suppkey, 2) as b, upper(to_base(s_suppkey, 36)) as c36, chr((65 + s_suppkey % 26)::int) || 'b' as ch from supplier")
def text_hex_conv(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", S.hex_of("s_suppkey", numeric=True).alias("h"), S.hex_of("s_name").alias("hs"), S.unhex(S.hex_of("s_name")).alias("back"), N.binary("s_suppkey").alias("b"), N.conv("s_suppkey", 10, 36).alias("c36"), S.char_of(k % 26 + 65, F.lit(98)).alias("ch"))


@plan("""select * from (values (1, '10.0.5.9', 167773449, '10.0.5.9'), (2, '256.1.1.1', null, null), (3, '127.1', 2130706433, '127.0.0.1'), (4, '1.2.3.', null, null)) v(id, s, n, back)""")
def text_inet(t: Tables) -> DataFrame:
    rows = t.rows([(1, "10.0.5.9"), (2, "256.1.1.1"), (3, "127.1"), (4, "1.2.3.")], "id int, s string")
    return rows.select("id", "s", S.inet_aton("s").alias("n"), S.inet_ntoa(S.inet_aton("s")).alias("back"))


@plan("select '%m.%d.%Y' as usa, '%H:%i:%s' as jis, '' as unknown")
def text_get_format(t: Tables) -> DataFrame:
    return t.constant(usa=S.get_format("date", "usa"), jis=S.get_format("time", "JIS"), unknown=S.get_format("date", "mars"))


@plan("select p_partkey, p_name as plain, true as changed from part")
def text_legacy_crypt(t: Tables) -> DataFrame:
    code = S.encode("p_name", "pass word")
    return t.part.select("p_partkey", S.decode(code, "pass word").alias("plain"), (code != F.col("p_name").cast("binary")).alias("changed"))


@plan("""select p_partkey, regexp_matches(p_name, 'i[nr]') as m, regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2-\\1') as r, regexp_extract(p_name, '[aeiou]+') as s, case when regexp_matches(p_name, '[aeiou]') then length(regexp_extract(p_name, '^[^aeiou]*')) + 1 else 0 end::int as i from part""")
def text_regexp(t: Tables) -> DataFrame:
    n = "p_name"
    return t.part.select("p_partkey", S.regexp_like(n, "i[nr]").alias("m"), S.regexp_replace(n, "([a-z]+) ([a-z]+)", r"\2-\1").alias("r"), S.regexp_substr(n, "[aeiou]+").alias("s"), S.regexp_instr(n, "[aeiou]").alias("i"))


@plan("""select s_suppkey, abs(s_acctbal) as a, sign(s_acctbal)::bigint as s, ceil(s_acctbal)::bigint as c, floor(s_acctbal)::bigint as f, trunc(s_acctbal * 10) / 10 as t, case when s_suppkey % 5 <> 0 then trunc(s_acctbal / (s_suppkey % 5))::bigint end as d,
case when s_suppkey % 5 <> 0 then s_suppkey % (s_suppkey % 5) end as m from supplier""")
def number_basic(t: Tables) -> DataFrame:
    b, k = "s_acctbal", F.col("s_suppkey") % 5
    return t.supplier.select("s_suppkey", N.absolute(b).alias("a"), N.sign(b).alias("s"), F.ceil(b).alias("c"), F.floor(b).alias("f"), N.truncate(b, 1).alias("t"), N.div(b, k).alias("d"), N.mod("s_suppkey", k).alias("m"))


@plan("""select x, case when x >= 0 then round(sqrt(x), 8) end as sq, case when x > 0 then round(ln(x), 8) end as l, case when x > 0 then round(log2(x), 8) end as l2, case when x > 0 then round(log10(x), 8) end as l10, case when x > 0 then round(ln(x) / ln(3), 8) end as l3,
round(exp(x / 10), 8) as e, round(pow(x, 2), 8) as p, case when abs(x) <= 1 then round(acos(x), 8) end as ac, case when abs(x) <= 1 then round(asin(x), 8) end as asn, round(atan(x), 8) as at, round(sin(x), 8) as si, round(cos(x), 8) as co, round(tan(x), 8) as ta,
case when x <> 0 then round(1 / tan(x), 8) end as ct, round(degrees(x), 8) as dg, round(radians(x), 8) as rd from (values (-15.0::double), (-0.5), (0), (0.25), (1), (8), (29.7)) v(x)""")
def number_domain_guards(t: Tables) -> DataFrame:
    rows = t.rows([(-15.0,), (-0.5,), (0.0,), (0.25,), (1.0,), (8.0,), (29.7,)], "x double")
    r8 = lambda c: F.round(c, 8)
    return rows.select(
        "x", r8(N.sqrt("x")).alias("sq"), r8(N.ln("x")).alias("l"), r8(N.log2("x")).alias("l2"), r8(N.log10("x")).alias("l10"), r8(N.log("x", 3)).alias("l3"), r8(N.exp(F.col("x") / 10)).alias("e"), r8(N.power("x", 2)).alias("p"),
        r8(N.acos("x")).alias("ac"), r8(N.asin("x")).alias("asn"), r8(N.atan("x")).alias("at"), r8(F.sin("x")).alias("si"), r8(F.cos("x")).alias("co"), r8(F.tan("x")).alias("ta"), r8(N.cot("x")).alias("ct"), r8(F.degrees("x")).alias("dg"), r8(F.radians("x")).alias("rd"),
    )


@plan("""select s_suppkey, bit_count(s_suppkey)::int as n, (s_suppkey & 12)::varchar as a, (s_suppkey | 9)::varchar as o, xor(s_suppkey, 5)::varchar as x, (18446744073709551615::decimal(20,0) - s_suppkey)::varchar as inv, (s_suppkey * 8)::varchar as sl, (s_suppkey // 4)::varchar as sr from supplier""")
def number_bits(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", N.bit_count(k).alias("n"), *[c.cast("string").alias(n) for c, n in ((N.bit_and(k, F.lit(12)), "a"), (N.bit_or(k, F.lit(9)), "o"), (N.bit_xor(k, F.lit(5)), "x"), (N.bit_not(k), "inv"), (N.shift_left(k, 3), "sl"), (N.shift_right(k, 2), "sr"))])


@plan("select p_partkey, md5(p_name) as m, sha1(p_name) as s1, sha256(p_name) as s2, format('{:,.2f}', p_retailprice) as f, round(p_retailprice, 1) as r from part")
def number_hashes_format(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.md5("p_name").alias("m"), N.sha1("p_name").alias("s1"), N.sha2("p_name", 256).alias("s2"), N.format_number("p_retailprice", 2).alias("f"), F.round("p_retailprice", 1).alias("r"))


@plan("select * from (values (1, 'abc', 891568578, 891568578), (2, '', 0, 0), (3, null, null, null)) v(id, s, c, c2)")
def number_crc32(t: Tables) -> DataFrame:
    rows = t.rows([(1, "abc"), (2, ""), (3, None)], "id int, s string")
    return rows.select("id", "s", N.crc32("s").alias("c"), N.crc32(F.when(F.col("id") > 0, F.col("s"))).alias("c2"))


@plan("select p_partkey, p_name as back, length(p_name)::bigint as n from part")
def number_compress(t: Tables) -> DataFrame:
    packed = N.compress("p_name")
    return t.part.select("p_partkey", N.uncompress(packed).alias("back"), N.uncompressed_length(packed).alias("n"))


@plan("""select * from (values (1, '12abc', 12, 12.0::double, 12.00::decimal(10,2), '12a'), (2, 'x', 0, 0, 0, 'x'), (3, '-3.567', -4, -3.567, -3.57, '-3.'), (4, null, null, null, null, null)) v(id, s, i, d, dc, ch)""")
def number_cast(t: Tables) -> DataFrame:
    rows = t.rows([(1, "12abc"), (2, "x"), (3, "-3.567"), (4, None)], "id int, s string")
    return rows.select("id", "s", N.convert("s", "signed").alias("i"), N.convert("s", "double").alias("d"), N.convert("s", "decimal(10,2)").alias("dc"), N.convert("s", "char(3)").alias("ch"))


@plan("select count(*) as n, count(*) filter (false) as outside from supplier")
def number_rand(t: Tables) -> DataFrame:
    r = t.supplier.select(N.rand(5).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("r") < 0) | (F.col("r") >= 1)).alias("outside"))


_L = "(values (1, 3, 9, 5), (2, null, 2, 8), (3, 4, null, 1)) v(id, a, b, c)"


@plan(f"""select id, case when a is not null and b is not null then greatest(a, b, c) end as g, case when a is not null and b is not null then least(a, b, c) end as l, coalesce(a, b, c) as co, ifnull(a, -1) as i, nullif(a, 3) as n, case when a > 3 then 'y' else 'n' end as f,
c between a and b as bt, (c < a or c > b) as nb, case when a in (3, null) then true end as il, case when a = 3 then 'three' when a is null then 'none' else 'other' end as d, a is null as isn, a is not distinct from b as ns from {_L}""")
def logic_functions(t: Tables) -> DataFrame:
    rows = t.rows([(1, 3, 9, 5), (2, None, 2, 8), (3, 4, None, 1)], "id int, a int, b int, c int")
    return rows.select(
        "id", L.greatest("a", "b", "c").alias("g"), L.least("a", "b", "c").alias("l"), L.coalesce("a", "b", "c").alias("co"), L.ifnull("a", F.lit(-1)).alias("i"), L.nullif("a", F.lit(3)).alias("n"), L.if_(F.col("a") > 3, F.lit("y"), F.lit("n")).alias("f"),
        L.between("c", "a", "b").alias("bt"), L.not_between("c", "a", "b").alias("nb"), L.in_list("a", 3, None).alias("il"), L.decode_oracle("a", 3, "three", None, "none", "other").alias("d"), L.is_null("a").alias("isn"), L.equal_null_safe("a", "b").alias("ns"),
    )


@plan("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end as band, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code from orders")
def logic_case(t: Tables) -> DataFrame:
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "middle").otherwise("low").alias("band"), F.when(s == "F", 1).when(s == "O", 2).alias("code"))


@plan("""select event_id, ts::date as d, year(ts)::int as y, quarter(ts)::int as q, month(ts)::int as m, day(ts)::int as dd, (dayofweek(ts) + 1)::int as dow, ((dayofweek(ts) + 6) % 7)::int as wd, dayofyear(ts)::int as doy, hour(ts)::int as h, minute(ts)::int as mi,
second(ts)::int as s, (microsecond(ts) % 1000000)::int as us, dayname(ts) as dn, monthname(ts) as mn, last_day(ts) as ld from events""")
def date_parts(t: Tables) -> DataFrame:
    x = "ts"
    return t.events.select(
        "event_id", D.date(x).alias("d"), D.year(x).alias("y"), D.quarter(x).alias("q"), D.month(x).alias("m"), D.day(x).alias("dd"), D.dayofweek(x).alias("dow"), D.weekday(x).alias("wd"), D.dayofyear(x).alias("doy"), D.hour(x).alias("h"), D.minute(x).alias("mi"),
        D.second(x).alias("s"), D.microsecond(x).alias("us"), D.dayname(x).alias("dn"), D.monthname(x).alias("mn"), D.last_day(x).alias("ld"),
    )


@plan("""select o_orderkey, (datediff('day', date '1970-01-01', o_orderdate::date) + 719528)::int as td, o_orderdate::date as fd, (datediff('day', date '1970-01-01', o_orderdate::date) + 719528) * 86400 as ts, epoch(o_orderdate)::bigint as ux, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as fu,
datediff('day', o_orderdate, timestamp '1998-01-01')::int as df, (o_orderdate + interval 1 month)::date as am, (o_orderdate - interval 10 day)::date as sd, o_orderdate + interval 90 minute as hm from orders""")
def date_arithmetic(t: Tables) -> DataFrame:
    x = "o_orderdate"
    return t.orders.select(
        "o_orderkey", D.to_days(x).alias("td"), D.from_days(D.to_days(x)).alias("fd"), D.to_seconds(x).alias("ts"), D.unix_timestamp(x).alias("ux"), D.from_unixtime(D.unix_timestamp(x)).alias("fu"), D.datediff(F.lit("1998-01-01"), x).alias("df"),
        D.date(D.date_add(x, 1, "MONTH")).alias("am"), D.date(D.date_sub(x, 10)).alias("sd"), D.date_add(x, "1:30", "HOUR_MINUTE").alias("hm"),
    )


@plan("""select o_orderkey, strftime(o_orderdate, '%d/%m/%y %A %B %j') as f, weekofyear(o_orderdate)::int as w3, isoyear(o_orderdate)::int * 100 + weekofyear(o_orderdate)::int as yw3, strftime(o_orderdate, '%U')::int as w0, strftime(o_orderdate, '%W')::int as w5, (year(o_orderdate) * 100 + month(o_orderdate))::bigint as ym from orders""")
def date_weeks_format(t: Tables) -> DataFrame:
    x = "o_orderdate"
    return t.orders.select("o_orderkey", D.date_format(x, "%d/%m/%y %W %M %j").alias("f"), D.weekofyear(x).alias("w3"), D.yearweek(x, 3).alias("yw3"), D.week(x, 0).alias("w0"), D.week(x, 5).alias("w5"), D.extract("YEAR_MONTH", x).alias("ym"))


@plan("""select o_orderkey, strftime(o_orderdate, '%U')::int as a, strftime(o_orderdate, '%W')::int as f, weekofyear(o_orderdate)::int as d from orders""")
def date_week_modes(t: Tables) -> DataFrame:
    x = "o_orderdate"
    return t.orders.select("o_orderkey", D.week(x, 0).alias("a"), D.week(x, 5).alias("f"), D.week(x, 3).alias("d"))


@plan("""select event_id, (hour(ts) * 100 + minute(ts))::bigint as hm, (day(ts) * 1000000 + hour(ts) * 10000 + minute(ts) * 100 + second(ts))::bigint as ds, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::int as sec, strftime(ts, '%H:%M:%S') as t, strftime(ts, '%I.%M %p') as tf,
datesub('month', ts, ts + interval 75 day)::bigint as mo, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000)::bigint as mins from events""")
def date_time_of_day(t: Tables) -> DataFrame:
    x = "ts"
    return t.events.select("event_id", D.extract("HOUR_MINUTE", x).alias("hm"), D.extract("DAY_SECOND", x).alias("ds"), D.time_to_sec(x).alias("sec"), D.time(x).alias("t"), D.time_format(x, "%h.%i %p").alias("tf"), D.timestampdiff("MONTH", x, D.date_add(x, 75)).alias("mo"), D.timestampdiff("MINUTE", F.lit("2024-01-01"), x).alias("mins"))


@plan("""select '12:05:09' as mk, null::varchar as bad, '-00:01:10' as st, '838:59:59' as top, '01:00:01' as td, '2024-03-01 00:30:00' as ad, '09:15:00' as sb, date '2024-02-29' as md, null::date as md0, 202503::bigint as pa, 14::bigint as pd, timestamp '2024-05-01 14:30:00' as sd, null::timestamp as sx, timestamp '2024-01-01 03:00:00' as tz""")
def date_constructors(t: Tables) -> DataFrame:
    return t.constant(
        mk=D.maketime(12, 5, 9), bad=D.maketime(12, 60, 0), st=D.sec_to_time(F.lit(-70)), top=D.sec_to_time(F.lit(9999999)), td=D.timediff(F.lit("2024-01-01 10:00:01"), F.lit("2024-01-01 09:00:00")), ad=D.addtime(F.lit("2024-02-29 23:00:00"), "1:30:00"),
        sb=D.subtime(F.lit("10:00:00"), "00:45:00"), md=D.makedate(2024, 60), md0=D.makedate(2024, 0), pa=D.period_add(202411, 4), pd=D.period_diff(202501, 202311), sd=D.str_to_date(F.lit("01.05.2024 14:30"), "%d.%m.%Y %H:%i"), sx=D.str_to_date(F.lit("x"), "%d"),
        tz=D.convert_tz(F.lit("2024-01-01 00:00:00"), "UTC", "Europe/Moscow"),
    )


@plan("select o_orderkey, o_orderdate + interval 3 hour as a, o_orderdate + interval 2 week as b, o_orderdate - interval 1 quarter as c, o_orderdate + interval 45 second as d, o_orderdate + interval 14 month as e from orders")
def date_intervals(t: Tables) -> DataFrame:
    x = "o_orderdate"
    return t.orders.select("o_orderkey", D.timestampadd("HOUR", 3, x).alias("a"), D.date_add(x, 2, "WEEK").alias("b"), D.date_sub(x, 1, "QUARTER").alias("c"), D.date_add(x, 45, "SECOND").alias("d"), D.date_add(x, "1-2", "YEAR_MONTH").alias("e"))


@plan("select true as same_day, true as recent")
def date_now(t: Tables) -> DataFrame:
    return t.constant(same_day=F.datediff(D.curdate(), D.now().cast("date")) == 0, recent=D.sysdate() > F.lit("2020-01-01").cast("timestamp"))
