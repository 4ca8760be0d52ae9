"""Format-preserving pseudonyms for personal data, with SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ROUNDS = 8
#: What each kind looks like. A match is replaced only if it is also valid (see `_pseudonym`).
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\x22']?[A-Za-z0-9_+/=.-]{8,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "intl": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,4}\)?[ .-]?){2,4}[0-9]{2,4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, kind: str, turn: str, value: str) -> str:
    """A keyed 60-bit number. `key` is SQL, as in all functions below: a column's name, so that the key itself is in no plan."""
    return f"cast(conv(substr(sha2(concat_ws(':', {key}, '{kind}', {turn}, {value}, {key}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, a: str, b: str, size_a: str, size_b: str, back: bool = False) -> str:
    """SQL for struct(a, b): a keyed permutation of the pairs with a < size_a and b < size_b.

    Rounds add a keyed function of one half to the other, modulo its own size, so the halves need no
    common size and every number keeps to its range. `back` undoes it.
    """
    sign, order = ("-", f"sequence({ROUNDS - 1}, 0, -1)") if back else ("+", f"sequence(0, {ROUNDS - 1})")
    step = (
        f"if(i % 2 = 0, named_struct('a', pmod(s.a {sign} {_prf(key, kind, 'i', 's.b')} % {size_a}, {size_a}), 'b', s.b),"
        f" named_struct('a', s.a, 'b', pmod(s.b {sign} {_prf(key, kind, 'i', 's.a')} % {size_b}, {size_b})))"
    )
    return f"aggregate({order}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> {step})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """m with its digits replaced in order, all else left where it is."""
    return f"array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) between '0' and '9', substr({digits}, length({_digits(f'substr({m}, 1, i)')}), 1), substr({m}, i, 1))), '')"


def _with(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _card(key: str) -> str:
    """Luhn numbers keep their first digit and stay Luhn numbers: the middle is permuted, the last digit follows."""
    high, low = "cast(pow(10, length(d) - 2 - (length(d) - 2) div 2) as bigint)", "cast(pow(10, (length(d) - 2) div 2) as bigint)"
    middle = "cast(substr(d, 2, length(d) - 2) as bigint)"
    turned = feistel(key, "card", f"{middle} div {low}", f"{middle} % {low}", high, low)
    base = _with(turned, "t", f"concat(substr(d, 1, 1), lpad(cast(t.a as string), length(d) - 2 - (length(d) - 2) div 2, '0'), lpad(cast(t.b as string), (length(d) - 2) div 2, '0'))")
    last = "element_at(filter(transform(sequence(0, 9), x -> concat(e, cast(x as string))), y -> luhn_check(y)), 1)"
    return _with(_digits("m"), "d", f"if(luhn_check(d), {_refill('m', _with(base, 'e', last))}, m)")


def _date(key: str) -> str:
    """Valid dates of 1800 to 2199, one whole cycle of the calendar: 146097 = 27 * 5411 days."""
    parts = "if(m like '%-%', m, if(cast(split(m, '/')[0] as int) > 12, concat_ws('-', split(m, '/')[2], lpad(split(m, '/')[1], 2, '0'), lpad(split(m, '/')[0], 2, '0')), concat_ws('-', split(m, '/')[2], lpad(split(m, '/')[0], 2, '0'), lpad(split(m, '/')[1], 2, '0'))))"
    turned = feistel(key, "date", "n div 5411", "n % 5411", "27", "5411")
    new = _with(turned, "t", "date_add(date'1800-01-01', cast(t.a * 5411 + t.b as int))")
    shown = _with(new, "x", "if(m like '%-%', date_format(x, 'yyyy-MM-dd'), if(cast(split(m, '/')[0] as int) > 12, date_format(x, 'dd/MM/yyyy'), date_format(x, 'MM/dd/yyyy')))")
    number = _with(f"datediff(try_cast({parts} as date), date'1800-01-01')", "n", f"if(n between 0 and 146096, {shown}, m)")
    return f"coalesce({number}, m)"


def _ip(key: str) -> str:
    octets = "transform(split(m, '[.]'), o -> cast(o as int))"
    turned = feistel(key, "ip", "q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536")
    shown = _with(turned, "t", "concat_ws('.', cast(t.a div 256 as string), cast(t.a % 256 as string), cast(t.b div 256 as string), cast(t.b % 256 as string))")
    return _with(octets, "q", f"if(forall(q, o -> o <= 255), {shown}, m)")


def _ssn(key: str) -> str:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    a, g, s = "cast(substr(m, 1, 3) as int)", "cast(substr(m, 5, 2) as int)", "cast(substr(m, 8, 4) as int)"
    turned = feistel(key, "ssn", f"({a} - if({a} > 666, 2, 1)) * 99 + {g} - 1", f"{s} - 1", "88902", "9999")
    shown = _with(turned, "t", "concat_ws('-', lpad(cast(t.a div 99 + if(t.a div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(t.a % 99 + 1 as string), 2, '0'), lpad(cast(t.b + 1 as string), 4, '0'))")
    return f"if({a} between 1 and 899 and {a} <> 666 and {g} > 0 and {s} > 0, {shown}, m)"


def _phone(key: str) -> str:
    """Area and exchange stay within 200 to 999; a country code stays."""
    turned = feistel(key, "phone", "(cast(substr(d, -10, 3) as int) - 200) * 800 + cast(substr(d, -7, 3) as int) - 200", "cast(substr(d, -4, 4) as int)", "640000", "10000")
    shown = _with(turned, "t", "concat(substr(d, 1, length(d) - 10), cast(t.a div 800 + 200 as string), cast(t.a % 800 + 200 as string), lpad(cast(t.b as string), 4, '0'))")
    return _with(_digits("m"), "d", _refill("m", shown))


def _intl(key: str) -> str:
    """Other numbers with a country code: all digits after the first group but four to fourteen at most."""
    size = "length(d) - 3"
    high, low = f"cast(pow(10, {size} - ({size}) div 2) as bigint)", f"cast(pow(10, ({size}) div 2) as bigint)"
    rest = "cast(substr(d, 4) as bigint)"
    turned = feistel(key, "intl", f"{rest} div {low}", f"{rest} % {low}", high, low)
    shown = _with(turned, "t", f"concat(substr(d, 1, 3), lpad(cast(t.a as string), {size} - ({size}) div 2, '0'), lpad(cast(t.b as string), ({size}) div 2, '0'))")
    return _with(_digits("m"), "d", f"if(length(d) between 8 and 15, {_refill('m', shown)}, m)")


def _iban(key: str) -> str:
    """IBANs whose check digits hold (modulo 97, piecewise) keep country, length and letters; their digits are permuted, and the check digits follow."""
    plain = "replace(m, ' ', '')"
    spread = "array_join(transform(split({0}, ''), c -> if(c rlike '[A-Z]', cast(ascii(c) - 55 as string), c)), '')"
    modulo = "aggregate(split({0}, ''), 0, (s, c) -> if(c = '', s, (s * 10 + cast(c as int)) % 97))"
    valid = modulo.format(spread.format("concat(substr(p, 5), substr(p, 1, 4))")) + " = 1"
    # the digits of the account are permuted in blocks of at most sixteen, each with the country, the letters and the earlier blocks as its tweak
    high, low = "cast(pow(10, length(x) - length(x) div 2) as bigint)", "cast(pow(10, length(x) div 2) as bigint)"
    kind = "iban', concat(substr(p, 1, 2), length(p), regexp_replace(substr(p, 5), '[0-9]', '#'), ':', y), '"
    turned = feistel(key, kind, f"cast(x as bigint) div {low}", f"cast(x as bigint) % {low}", high, low)
    block = _with(turned, "t", "concat(lpad(cast(t.a as string), length(x) - length(x) div 2, '0'), if(length(x) < 2, '', lpad(cast(t.b as string), length(x) div 2, '0')))")
    blocks = f"aggregate(sequence(0, (length(d) - 1) div 16), '', (y, n) -> concat(y, {_with('substr(d, n * 16 + 1, 16)', 'x', block)}))"
    fresh = _with("regexp_replace(substr(p, 5), '[^0-9]', '')", "d", f"if(d = '', '', {blocks})")
    body = _with(fresh, "g", "array_join(transform(sequence(5, length(p)), i -> if(substr(p, i, 1) between '0' and '9', substr(g, length(regexp_replace(substr(p, 5, i - 4), '[^0-9]', '')), 1), substr(p, i, 1))), '')")
    check = "lpad(cast(98 - " + modulo.format(spread.format("concat(b, substr(p, 1, 2), '00')")) + " as string), 2, '0')"
    whole = _with(body, "b", f"concat(substr(p, 1, 2), {check}, b)")
    fill = "array_join(transform(sequence(1, length(m)), i -> if(substr(m, i, 1) = ' ', ' ', substr(w, length(replace(substr(m, 1, i), ' ', '')), 1))), '')"
    return _with(plain, "p", f"if({valid}, {_with(whole, 'w', fill)}, m)")


def _alias(key: str, kind: str, value: str) -> str:
    """Hexadecimal characters of a keyed digest, as many as the value has, 64 at most."""
    return f"substr(sha2(concat_ws(':', {key}, '{kind}', {value}, {key}), 256), 1, greatest(8, length({value})))"


def _pseudonym(key: str) -> str:
    """SQL for what replaces the match m: chosen by its form, unchanged where the validation fails."""
    head = r"regexp_extract(m, '^([A-Za-z_-]+[ ]?[=:][ ]?[\\x22\\x27]?)', 1)"
    made = {
        "email": f"concat({_alias(key, 'email', 'lower(m)')[:-1].replace('greatest(8, length(lower(m)))', '12')}), '@', substring_index(m, '@', -1))",
        "secret": f"concat({head}, {_alias(key, 'secret', f'substr(m, length({head}) + 1)')})",
        "key": f"concat(substr(m, 1, 4), upper({_alias(key, 'key', 'substr(m, 5)')}))",
        "iban": _iban(key),
        "date": _date(key),
        "ip": _ip(key),
        "ssn": _ssn(key),
        "phone": _phone(key),
        "intl": _intl(key),
        "card": _card(key),
    }
    return "case " + " ".join(f"when m rlike {_quoted('^(?:' + PATTERNS[k] + ')$')} then {v}" for k, v in made.items()) + " else m end"


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found, n_replaced of every row of documents, in one pass without a shuffle.

    Card numbers (Luhn), social security numbers, phone numbers, IPv4 addresses and dates are permuted
    within their format by a keyed Feistel network, as are the digits of IBANs, whose check digits follow, so that equal values become equal pseudonyms in all
    documents and different ones stay different; e-mail names, keys and secrets, which have no fixed form, become keyed digests of
    the same kind of characters. Matches that fail their
    validation (a false Luhn digit, an octet over 255, no such day) are found, but stay. A null text is
    empty; repeated rows and null doc_ids give a row each; very long texts are read whole; only doc_id and text are read, so other
    columns may have any names; an empty table gives no rows. The key is a scalar subquery's value: plans and event logs don't show it.
    """
    pattern = _quoted("|".join(f"(?:{x})" for x in PATTERNS.values()))
    secret = documents.sparkSession.createDataFrame([(key,)], "k string").scalar()
    rows = texts(documents, secret.alias("pii_key")).withColumn("m", F.expr(f"if(text rlike '[0-9@=:]|AKIA|ASIA', regexp_extract_all(text, {pattern}, 0), cast(array() as array<string>))"))
    rows = rows.withColumn("made", F.expr(f"transform(m, m -> {_pseudonym('pii_key')})"))
    joined = F.expr(f"if(size(m) = 0, text, array_join(flatten(zip_with(split(text, {pattern}, -1), made, (p, x) -> array(p, x))), ''))")
    return rows.select("doc_id", joined.alias("text"), F.size("m").cast("long").alias("n_found"), F.expr("cast(size(filter(zip_with(m, made, (x, y) -> x <> y), z -> z)) as bigint)").alias("n_replaced"))
