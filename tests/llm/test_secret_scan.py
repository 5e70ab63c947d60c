import hashlib
import re

import pytest

pytest.importorskip("loomline.llm")
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import secret_scan as S


def base(text):
    """The patterns as written, failing matches dropped."""
    spans = []
    word = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for kind, pattern, fits in (
        ("assign", "(" + word + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(spans)


PIECES = ["password", "Passwd", "SECRET", "token", "api_key", "apiKEY", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "1234567", "89abcdef", "0" * 31, "f", "\n", "\t", "é", "+/=", "x", "secret=token=abcdefgh"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans(text):
    assert S.base_spans(text) == base(text)


def literals(text):
    return [text[a:b] for a, _, b in S.literal_spans(text)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("db_pwd = 'Zx81kq0Lmn2'", ["Zx81kq0Lmn2"]),
        ("K = 'Zx81kq0Lmn2'\nx = 1\nauth_header = K", ["Zx81kq0Lmn2"]),
        ("A = 'Zx81kq0Lmn2'\nB = A\nsigning-key: B", ["Zx81kq0Lmn2"]),
        ("--private-key=Zx81kq0Lmn2 run", ["Zx81kq0Lmn2"]),
        ('{"clientCredential": "Zx81kq0Lmn2"}', ["Zx81kq0Lmn2"]),
        ("colour = 'Zx81kq0Lmn2'", []),
        ("db_pwd = 'changeme'", []),
        ("the keyword: something else entirely", []),
        ("session = abcdefghijkl", []),
        ("note: see page 12 of the plan", []),
    ],
)
def test_names_decide(text, found):
    assert literals(text) == found


def test_rows(spark):
    rows = [(1, "x password=abcdefgh1 y"), (2, None), (3, ""), (None, "é token: 'abcdefgh'"), (1, "x password=abcdefgh1 y"), (4, "w " * 200_000 + "AKIA" + "B" * 12)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    got = S.scan_secrets(df).collect()
    assert [g.doc_id for g in got] == [i for i, _ in rows]
    for g, (_, t) in zip(got, rows):
        want = base(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (g.n_assign, g.n_access, g.n_hex) == tuple([k for _, k, _ in want].count(n) for n in range(3))
        assert set(filter(None, text.split(","))) <= set(g.spans.split(","))
    assert S.scan_secrets(df.limit(0)).count() == 0


LONG = "Zx81kq0Lmn2" * 182


@pytest.mark.parametrize(
    "text, found",
    [
        (f'private_key = "{LONG}"', [LONG]),
        (f"private_key = {LONG} end", [LONG]),
        ("a" * 200 + "_signing_key = 'Zx81kq0Lmn2'", ["Zx81kq0Lmn2"]),
        ("private_key            =\t          'Zx81kq0Lmn2'", ["Zx81kq0Lmn2"]),
        ("private_key\t=\t'Zx81kq0Lmn2'", ["Zx81kq0Lmn2"]),
        ('private_key = """Zx81kq0Lmn2\nYw92"""', ["Zx81kq0Lmn2\nYw92"]),
        ("private_key = \'\'\'Zx81kq0Lmn2\'\'\'", ["Zx81kq0Lmn2"]),
        ('signing_key: str = "Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ('signing_key: Optional[str] = "Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ('signing_key: str | None = "Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ('signing_key: str="Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ('else: private_key = "Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ("else: private_key=Zx81kq0Lmn2", ["Zx81kq0Lmn2"]),
        ("else: private_key: Zx81kq0Lmn2", ["Zx81kq0Lmn2"]),
        ('signing_key = a = b = "Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ('signing_key=a=b="Zx81kq0Lmn2"', ["Zx81kq0Lmn2"]),
        ("signing_key: Zx81kq0Lmn2== next", ["Zx81kq0Lmn2=="]),
        ("private_key: https://example.org/page-12", []),
        ("colour: str = 'Zx81kq0Lmn2'", []),
    ],
)
def test_no_bounds_on_pairs(text, found):
    assert literals(text) == found


K = "Zx81kq0Lmn2"


@pytest.mark.parametrize(
    "text, found",
    [
        ("db_pwd = 'Zx81\"kq0Lmn2'", ['Zx81"kq0Lmn2']),
        ("db_pwd = 'Zx81kq0\\'Lmn2abc'", ["Zx81kq0\\'Lmn2abc"]),
        ("db_pwd = 'Zx81kq0' + 'Lmn2abcd'", ["Zx81kq0' + 'Lmn2abcd"]),
        ('db_pwd = "Zx81kq0" . "Lmn2abcd";', ['Zx81kq0" . "Lmn2abcd']),
        ("db_pwd = ('x')", []),
        ("db_pwd = 'Zx81' \\\n  'kq0Lmn2'", ["Zx81' \\\n  'kq0Lmn2"]),
        (f"db_pwd = r'{K}'", [K]),
        (f"cfg['db_pwd'] = '{K}'", [K]),
        (f'cfg["db_pwd"]="{K}"', [K]),
        (f"define('DB_PWD', '{K}');", [K]),
        (f'os.putenv("DB_PWD", "{K}")', [K]),
        (f"put('colour', '{K}')", []),
        (f"auth_header = LATER\nLATER = '{K}'", [K]),
        (f"signing_key: A\nA = B\nB = '{K}'", [K]),
        (f"A = '{K}'\nx = A\nA = 'plain'\nauth_token = A", []),
        ("A = B\nB = A\ndb_pwd = A", []),
        ("passphrase = 'correct-horse-battery-staple'", ["correct-horse-battery-staple"]),
        ("passphrase = 'correct horse battery staple'", []),
        ("passphrase = correct-horse-battery-staple", []),
        (f"don't set db_pwd='{K}' here, it's bad", [K]),
        (f"<db_pwd>{K}</db_pwd>", [K]),
        ('db_pwd = """' + K, []),
    ],
)
def test_syntax(text, found):
    assert literals(text) == found


def plain_literals(text):
    """A character-by-character reading of ``name = 'string'`` lines with references, the way the lexer is meant to see them."""
    pairs = []
    for line in text.split("\n"):
        name, _, value = (x.strip() for x in line.partition("="))
        if value[:1] in ("'", '"'):
            out, i = [], 1
            while i < len(value) and value[i] != value[0]:
                i += 2 if value[i] == "\\" else 1
            pairs.append((name, value[1:i], None))
        else:
            pairs.append((name, None, value))
    out = {}
    for i, (name, value, ref) in enumerate(pairs):
        seen, at = set(), i
        while pairs[at][2] is not None and at not in seen:
            seen.add(at)
            earlier = [j for j in range(at) if pairs[j][0] == pairs[at][2]]
            later = [j for j in range(at, len(pairs)) if pairs[j][0] == pairs[at][2]]
            if not earlier + later:
                break
            at = (earlier[-1:] or later[:1])[0]
        literal = pairs[at][1]
        if literal is not None:
            out[at] = max(out.get(at, 0), S.name_weight(name))
    return [pairs[at][1] for at, w in sorted(out.items()) if w and S.literal_score(pairs[at][1], w) >= S.LEAST_SCORE]


VALUES = st.sampled_from(["'Zx81kq0Lmn2'", '"Zx8\'1kq0Lmn2"', "'Zx8\\'1kq0Lmn2'", "'changeme'", "A", "B", "other"])
LINES = st.lists(st.tuples(st.sampled_from(["A", "B", "db_pwd", "colour", "auth_token"]), VALUES), min_size=1, max_size=7)


@given(LINES)
@settings(max_examples=400, deadline=None)
def test_bindings_against_a_plain_reading(lines):
    text = "\n".join(f"{n} = {v}" for n, v in lines)
    assert [x for x in literals(text)] == plain_literals(text)


@pytest.mark.parametrize("text", ["key=" * 250_000, "k='\\" * 250_000, "k='a' + " * 120_000, "k['a']=" * 150_000, "A=B\nB=A\n" * 100_000, "('k', " * 150_000, 'k=r"' * 250_000, "a: b[" * 200_000, "k = " * 250_000, "a" * 1_000_000, "k" + " " * 1_000_000, "k='" * 300_000, 'k="""' * 160_000, "a: b | " * 140_000, "key: a" + ".b" * 500_000])
def test_long_texts_take_linear_time(text):
    from time import process_time

    start = process_time()
    S.literal_spans(text)
    assert process_time() - start < 20
