"""The lexer on hostile texts, and what the gate before it lets through."""

import random
import time

import pytest

from tokenloom.llm import lexer, secrets

VALUE = "Abcdef123456xyz!"


def test_comments_in_comments():
    for opener in ("# ", "// ", "# // "):
        text = "key = 1\n" + opener * 100_000 + f"secret='{VALUE}'\n// x=1" + " // x=1" * 1200
        assert ("literal", text.index(VALUE), text.index(VALUE) + len(VALUE)) in secrets.scan(text)


#: Openers without an end, names bound in turn, deep scopes and brackets, long lines.
UNITS = ["/* ", "<!-- ", "a = a\n", "a = b\nb = a\n", '\\"', '"""\\', "'''a ", "`", "{ a = b\n", "token = ((((", "def a ", "self.token = self.x\n", "class A:\n x = self.y\n", "token: a = \n", "'", "<token>x", 'a["token"] = b\n', 'key="token" value=x\n']


@pytest.mark.parametrize("unit", UNITS)
def test_time_grows_with_the_text(unit):
    took = []
    for size in (250_000, 1_000_000):
        text = "token : secret\n" + unit * (size // len(unit))
        began = time.process_time()
        secrets.scan(text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.2)  # four times the text


def test_doubling_values_stay_small():
    text = f"a0 = '{VALUE}'\n" + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(60)) + "secret = a60\ntoken_of = a3\n"
    assert [x for x in secrets.scan(text) if x[0] == "literal"] == [("literal", 6, 6 + len(VALUE))]


def test_the_gate_loses_nothing():
    rng = random.Random(7)
    words = [*secrets.SENSITIVE, "pass", "word", "phrase", "api", "key", "pri", "vate", "my", "db", "x1", "user"]
    for _ in range(3000):
        parts = rng.choices(words, k=rng.randint(1, 3))
        parts = [rng.choice((p, p.capitalize(), p.upper(), p[: len(p) // 2] + "_" + p[len(p) // 2 :])) for p in parts]
        name = rng.choice(("", "_", "-", ".")).join(parts)
        text = rng.choice(("{} = '{}'", '"{}": "{}"', "--{} {}", "<{}>{}</x>")).format(name, VALUE)
        if secrets.lexed(text):
            assert [x for x in secrets.scan(text) if x[0] == "literal"], text
    assert secrets.scan(f"pass_word = '{VALUE}'") and secrets.scan(f"pass_phrase = '{VALUE}'")


def test_nearest_scope_and_place():
    text = f"a = '{VALUE}1'\nb = {{\n a = '{VALUE}2'\n c = {{ token = a }}\n}}\nsecret = a\na = '{VALUE}3'\npassword = a\n"
    assert dict((n, [text[s:e] for s, e in spans]) for n, spans in lexer.named_literals(text) if n in ("token", "secret", "password")) == {"token": [VALUE + "2"], "secret": [VALUE + "1"], "password": [VALUE + "3"]}


def test_unended_strings_and_escapes():
    assert [text[s:e] for text in ["token = 'a\\'b" + VALUE + "'"] for _, spans in lexer.named_literals(text) for s, e in spans] == ["a\\'b" + VALUE]
    text = f'x = """unended\nsecret = "{VALUE}"\n'
    assert ("literal", text.index(VALUE), text.index(VALUE) + len(VALUE)) in secrets.scan(text)
    text = f"/* unended\nsecret = '{VALUE}'\n"
    assert ("literal", text.index(VALUE), text.index(VALUE) + len(VALUE)) in secrets.scan(text)
