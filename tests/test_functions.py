import datetime
import decimal

import pytest

from tideline.errors import EngineError
from tideline.functions.dialect import kind_in, to_spark
from tideline.functions.scalar import FUNCTIONS, java_format

CASES = {
    "i / 0": None, "i % 0": None, "i div 2": 3, "i / 2": 3.5, "i div 0": None, "greatest(1, null)": None, "least(3, 2)": 2, "round(d)": 2.0, "round(dec, 2)": 12.35,
    "substring('abc', 0, 2)": "", "substring('abc', -2, 2)": "bc", "substring('abc', 9, 1)": "", "length(s)": 6, "char_length(s)": 5, "ascii('é')": 195, "ord('é')": 50089,
    "lpad('abc', -1, 'x')": None, "lpad('ab', 5, 'xy')": "xyxab", "rpad('abcd', 2, '')": "ab", "rpad('a', 3, '')": None, "interval(23, 1, 15, 17, 30, 44, 200)": 3, "interval(null, 1)": -1,
    "field('b', 'a', 'b')": 2, "field(null, 'a')": 0, "elt(2, 'a', 'b')": "b", "elt(3, 'a')": None, "export_set(5, 'Y', 'N', ',', 4)": "Y,N,Y,N", "make_set(5, 'a', 'b', 'c')": "a,c",
    "quote('don''t')": "'don\\'t'", "quote(null)": "NULL", "strcmp('a', 'b')": -1, "strcmp(null, 'b')": None, "date_format(t, '%H:%i:%s::%f %d/%m/%y')": "01:11:00::654321 01/03/20",
    "unix_timestamp(t)": 1583025060.654321, "~1": 18446744073709551614, "-8 >> 1": 9223372036854775804, "1 << 64": 0, "insert('Quadratic', 3, 4, 'What')": "QuWhattic", "insert('Quadratic', -1, 4, 'What')": "Quadratic",
    "substring_index('www.mysql.com', '.', -2)": "mysql.com", "trim(both 'xy' from 'xyxyaxy')": "a", "trim(leading 'x' from 'xxax')": "ax", "if(0, 'a', 'b')": "b", "1 xor 1": False, "not 0": True, "null and 0": False,
    "3 between 1 and 5 and 1": True, "i in (1, 7)": True, "i not in (1, null)": None, "s like 'h_llo'": True, "'a%' like 'a|%' escape '|'": True, "truncate(-1.999, 1)": -1.9, "truncate(d, 0)": 2.0, "conv('ff', 16, 10)": "255",
    "sqrt(-1)": None, "acos(2)": None, "ln(0)": None, "microsecond(t)": 654321, "case i when 7 then 'x' else 'y' end": "x", "null <=> null": True, "hex(255)": "FF", "unhex('4D7953514C')": "MySQL",
    "from_base64(to_base64('abc'))": "abc", "oct(12)": "14", "char(77, 121)": "My", "format(12332.1234, 2)": "12,332.12", "locate('bar', 'foobarbar', 5)": 7, "locate('x', null)": None, "from_unixtime(1583025060.654321, '%Y')": "2020",
    "cast('12' as signed)": 12, "repeat('ab', -1)": "", "ifnull(n, 'z')": "z", "position('b' in 'abc')": 2, "i is true": True, "n is null": True, "-i": -7, "bin(5)": "101", "log(2, 8)": 3.0, "isnull(n)": 1, "left(s, 2)": "hé", "right('abc', 0)": "",
    "date_format(t, '%D %w %U %u %V %v %X %x')": "1st 0 09 09 09 09 2020 2020", "week('2008-02-20')": 7, "week('2008-02-20', 1)": 8, "week('2008-12-31', 1)": 53, "week('2000-01-01', 0)": 0, "week('2000-01-01', 2)": 52, "yearweek('1987-01-01')": 198652,
    "week('2021-01-03', 5)": 0, "week('2021-01-04', 7)": 1, "format(2.5, 0)": "3", "format(0.125, 2)": "0.13", "format(-0.125, 1 + 1)": "-0.13", "char(300)": "\x01,", "char(null)": "", "unhex('zz')": None, "from_base64('*')": None, "elt(2.4, 'a', 'b')": "b", "elt(1.5, 'a', 'b')": "b",
    "to_days('2007-10-07')": 733321, "period_add(200801, 2)": 200803, "period_diff(200802, 200703)": 11, "to_seconds('2009-11-29')": 63426672000, "sec_to_time(2378)": "00:39:38", "time_to_sec('22:23:00')": 80580, "maketime(12, 15, 30)": "12:15:30", "timediff('2008-12-31 23:59:59', '2008-12-30 01:01:02')": "46:58:57",
    "timestampdiff(month, '2003-02-01', '2003-05-01')": 3, "extract(minute from t)": 11, "dayname(t)": "Sunday", "monthname(t)": "March", "s regexp '^h'": True, "s not regexp 'l+o$'": False, "json_quote('a\"b')": '"a\\"b"', "json_array(1, 'a')": '[1,"a"]', "s collate utf8mb4_general_ci = 'HéLLO'": True,
    "crc32('MySQL')": 3259397556, "space(2)": "  ", "find_in_set('b', 'a,b')": 2, "1 + 2 * 3": 7, "2 = 2 or 1 / 0": True, "sign(-3)": -1, "mod(7, 3)": 1, "reverse('abc')": "cba", "year(t)": 2020,
}


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([(7, 2.5, "héllo", None)], "i bigint, d double, s string, n string")
    return df.selectExpr("*", "cast(12.345 as decimal(10, 3)) as dec", "timestamp'2020-03-01 01:11:00.654321' as t").cache()


def test_expressions(row):
    kind = kind_in(row)
    got = row.selectExpr(*[f"{to_spark(text, kind)} as c{i}" for i, text in enumerate(CASES)]).first()
    for i, (text, want) in enumerate(CASES.items()):
        x = got[i]
        if isinstance(x, decimal.Decimal):
            x = float(x) if isinstance(want, float) else int(x)
        assert x == want, (text, x, want)


def test_timestamp_plus_time(row):
    assert row.selectExpr(to_spark("timestamp(t, '01:30:00')", kind_in(row))).first()[0] == datetime.datetime(2020, 3, 1, 2, 41, 0, 654321)


def test_spans_of_a_hundred_hours_and_more(row):
    cases = {
        "sec_to_time(359999)": "99:59:59", "sec_to_time(360000)": "100:00:00", "sec_to_time(-445566)": "-123:46:06", "sec_to_time(6000000)": "1666:40:00", "sec_to_time(null)": None, "maketime(120, 1, 2)": "120:01:02",
        "timediff('2008-12-31 23:59:59', '2008-12-01 00:00:00')": "743:59:59", "time_to_sec(sec_to_time(445566))": 445566,
    }
    assert row.selectExpr(*[to_spark(text, kind_in(row)) for text in cases]).first()[:] == tuple(cases.values())


def test_all_names_of_the_dialect_are_there():
    want = "coalesce isnull greatest least interval abs acos asin atan atan2 ceil ceiling conv cos cot crc32 degrees exp floor ln log log2 log10 pi pow power radians rand round sign sin sqrt tan truncate year month day hour minute second microsecond date_format unix_timestamp from_unixtime timestamp ascii bin concat concat_ws convert elt export_set field format from_base64 insert instr lcase left right length load_file locate lower lpad ltrim make_set mid oct octet_length ord position quote repeat replace reverse rtrim space strcmp substring substr substring_index to_base64 trim upper ucase hex unhex rpad bit_length char char_length character_length find_in_set weight_string if ifnull mod"
    assert not set(want.split()) - set(FUNCTIONS)


@pytest.mark.parametrize("text", ["abs(", "1 +", "substring('a')", "load_file('x')", "case when 1 end", "date_format(t, i)"])
def test_errors(row, text):
    with pytest.raises(EngineError):
        to_spark(text, kind_in(row))


def test_malformed_numbers_are_errors(row):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        row.selectExpr(to_spark("cast('abc' as signed)")).collect()


def test_java_format():
    assert java_format("%Y-%m-%d it's %H%%") == "yyyy-MM-dd' it''s 'HH%"
