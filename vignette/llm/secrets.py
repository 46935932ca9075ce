"""Operator 4: secret scan. A character convolutional network in numpy judges every candidate in its context.

A candidate is a run of MIN_RUN or more characters of [A-Za-z0-9_+/-] with a digit, one of LONG_RUN or more without, or
one that a ':' or '=' leads in; the whole non-blank or quoted run, of any length and any characters, that a ':', a '='
or a credential word leads in; and any non-blank run of MIN_RUN or more with a letter, a digit and other signs, without
brackets and sentence signs at its ends. Runs with structure are taken apart and never a candidate as a whole: of a URL the password and the
values of the query, of a list of key=value pairs the values. There is no other filter, the network decides. Where such
runs lie in one another and several are secrets, the widest is the finding. The network sees windows of the candidate's
characters (as many overlapping windows as a long candidate needs) with LEFT and RIGHT characters of context and a marker
of what belongs to the candidate. It is trained here, on findings with known labels that a seeded generator writes:
credentials of many issuers, passwords and connection strings against card numbers, addresses, checksums, commit ids,
uuids, dates, file names, names of settings and the like. Scores are calibrated by Platt scaling on held-out findings,
which are found by candidates() like any other text; the threshold is the largest that keeps RECALL of the held-out
secrets, those counted that no candidate covers.

Cases: null and empty texts have no findings; a candidate is seen whole however long; findings of repeated rows
repeat; flagged runs that cross without lying in one another are told by the one that begins first, of equal beginnings
the wider; an empty table has no findings; other columns are not looked at.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, utf8

MIN_RUN = 8
LONG_RUN = 16
LEFT, BODY, RIGHT = 24, 48, 8
STRIDE = 32
WIDTH = LEFT + BODY + RIGHT
RECALL = 0.99
EXAMPLES = 18_000
MASK = b"[SECRET]"

_CLASS = np.zeros(256, bool)
_CLASS[[ord(c) for c in string.ascii_letters + string.digits + "_+/-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in string.ascii_letters]] = True


_WORDS = rb"(?<![a-zA-Z])(?:pass(?:word|wd|phrase|code|wort)?|pwd|kennwort|secret|token|credentials?|(?:api|access|secret|private|encryption|session)[_-]?key|bearer)(?![a-zA-Z])"
_LED = re.compile(rb"(?:[:=]+>?[^\S\n]*|" + _WORDS + rb"[\"']?(?:\s+(?:is|was|ist|war|est|es|era)\b)?[\s:=>]+)(?:\"([^\"\s]+)|'([^'\s]+)|([^\s\"':=]\S*))", re.I)


_PAIR = re.compile(rb"[;&,?](?=[\w.-]+=)")
_USER = re.compile(rb"//[^\s/:@]*:(\S+)@")
_VALUE = re.compile(rb"[?&;][\w.-]+=([^&;#\s]+)")
_LABEL = re.compile(rb"[a-zA-Z_][\w.-]*[:=]+[^\s:=]")
_KEYED = re.compile(rb"[\w.-]+=(?!=)")


def parts(data: bytes, a: int, b: int):
    """(start, end) of what the run data[a:b] holds: its values, if it is a URL or a list of pairs, else itself."""
    run = data[a:b]
    if b"//" in run and (run.startswith(b"//") or b"://" in run):
        if m := _USER.search(run):
            yield a + m.start(1), a + m.end(1)
        for m in _VALUE.finditer(run):
            yield a + m.start(1), a + m.end(1)
        return
    cuts = [m.start() for m in _PAIR.finditer(run)]
    if not cuts:
        yield a, b
        if (m := _KEYED.match(run)) and m.end() < len(run):
            yield a + m.end(), b
        return
    for x, y in zip([-1, *cuts], [*cuts, len(run)]):
        x += 1
        if m := _KEYED.match(run, x, y):
            x = m.end()
        if x < y:
            yield a + x, a + y


def led_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the non-blank or quoted runs that a ':', a '=' or a credential word leads in, taken apart."""
    data, out = raw.tobytes(), []
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        for m in _LED.finditer(text):
            out += [(a + offsets[i], b + offsets[i], i) for a, b in parts(text, *m.span(m.lastindex))]
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


_OPEN, _CLOSE = b"([{<*#%&$|`~", b".,;:!?)]}>*#%&$|`~"
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33), 34, 39, 127]] = True


def spans(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of at least `least` bytes where `inside` holds; none crosses a row's end."""
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    head[cuts] = inside[cuts]
    tail[:-1] &= ~inside[1:]
    tail[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    long = end - start >= least
    return start[long], end[long]


def whole_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs without blanks and quotes that hold a letter, a digit and other signs, taken apart."""
    start, end = spans(~_EDGE[raw], offsets, MIN_RUN)
    count = lambda of: (sums := np.concatenate([[0], np.cumsum(of[raw], dtype=np.int64)]))[end] - sums[start]
    some = (count(_DIGIT) > 0) & (count(_LETTER) > 0) & (count(_CLASS) < end - start)
    start, end = start[some], end[some]
    out = []
    for a, b, r in zip(start.tolist(), end.tolist(), (np.searchsorted(offsets, start, side="right") - 1).tolist()):
        run = raw[a:b].tobytes()
        short = run.lstrip(_OPEN)
        a += len(run) - len(short)
        if not _LABEL.match(short):  # what stands behind a label is led in
            short = short.rstrip(_CLOSE)
            out += [(x + a, y + a, r) for x, y in parts(short, 0, len(short)) if y - x >= MIN_RUN]
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def candidates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) byte spans of all candidates, each once, by start, then the wider first."""
    both = np.concatenate([np.stack(f(raw, offsets)) for f in (runs, led_runs, whole_runs)], axis=1)
    start, minus, row = np.unique(both * np.array([[1], [-1], [1]]), axis=1)
    return start, -minus, row


def outermost(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans, ordered as candidates() does, begin after all before them have ended."""
    reach = np.maximum.accumulate(np.concatenate([[0], end[:-1]])) if len(end) else end
    return start >= reach


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the candidates among runs of the class; vectorised over the whole buffer."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = spans(_CLASS[raw], offsets, MIN_RUN)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw], dtype=np.int64)])
    row = np.searchsorted(offsets, start, side="right") - 1
    first = offsets[row]
    led = np.zeros(len(start), bool)
    for back in (1, 2, 3):  # value of `name = "value"`, `name: value` and the like
        at = start - back
        ok = at >= first
        before = raw[np.maximum(at, 0)]
        led |= ok & ((before == 58) | (before == 61)) & ~led
        blank = ok & ((before == 32) | (before == 34) | (before == 39))
        first = np.where(blank, first, start)  # stop where something else stands between
    take = (digits[end] > digits[start]) | led | (end - start >= LONG_RUN)
    return start[take], end[take], row[take]


def windows(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, marks, owner): WIDTH bytes of each window (0 beyond the text), 1 where the candidate is, candidate number."""
    count = np.maximum(1, -(-(end - start - BODY) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (start[owner] + nth * STRIDE - LEFT)[:, None] + np.arange(WIDTH)
    known = (at >= offsets[row][owner][:, None]) & (at < offsets[row + 1][owner][:, None])
    codes = np.where(known, raw[np.clip(at, 0, max(0, len(raw) - 1))], 0).astype(np.uint8) if len(raw) else np.zeros(at.shape, np.uint8)
    return codes, (at >= start[owner][:, None]) & (at < end[owner][:, None]), owner


class Network:
    """Embedding, two stacked convolutions with ReLU, max and mean pooling, one logistic unit."""

    EMBED, FIRST, SECOND, K = 12, 32, 32, 5

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        e = self.EMBED + 1
        self.w = {"emb": (g.standard_normal((256, self.EMBED)) * 0.5).astype(np.float32), "a": r(self.K * e, self.FIRST), "ab": np.zeros(self.FIRST, np.float32), "b": r(self.K * self.FIRST, self.SECOND), "bb": np.zeros(self.SECOND, np.float32), "o": r(2 * self.SECOND, 1)[:, 0], "ob": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _unfold(x: np.ndarray, k: int) -> np.ndarray:
        n, length, d = x.shape
        return np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(n, length - k + 1, k * d)

    def forward(self, codes: np.ndarray, marks: np.ndarray, keep: bool = False):
        w = self.w
        x = np.concatenate([w["emb"][codes], marks[:, :, None].astype(np.float32)], axis=2)
        u = self._unfold(x, self.K)
        h = np.maximum(u @ w["a"] + w["ab"], 0)
        v = self._unfold(h, self.K)
        z = np.maximum(v @ w["b"] + w["bb"], 0)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
        logit = pooled @ w["o"] + w["ob"]
        return (logit, (codes, u, h, v, z, top, pooled)) if keep else logit

    def gradients(self, state, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        codes, u, h, v, z, top, pooled = state
        w, g = self.w, {}
        g["o"], g["ob"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * w["o"]
        dz = np.repeat(d_pool[:, None, self.SECOND :] / z.shape[1], z.shape[1], axis=1)
        np.put_along_axis(dz, top[:, None], np.take_along_axis(dz, top[:, None], 1) + d_pool[:, None, : self.SECOND], 1)
        dz *= z > 0
        g["b"], g["bb"] = np.tensordot(v, dz, ((0, 1), (0, 1))), dz.sum((0, 1))
        dv = (dz @ w["b"].T).reshape(*dz.shape[:2], self.K, self.FIRST)
        dh = np.zeros_like(h)
        for k in range(self.K):
            dh[:, k : k + dv.shape[1]] += dv[:, :, k]
        dh *= h > 0
        g["a"], g["ab"] = np.tensordot(u, dh, ((0, 1), (0, 1))), dh.sum((0, 1))
        du = (dh @ w["a"].T).reshape(*dh.shape[:2], self.K, self.EMBED + 1)
        dx = np.zeros((len(codes), WIDTH, self.EMBED), np.float32)
        for k in range(self.K):
            dx[:, k : k + du.shape[1]] += du[:, :, k, : self.EMBED]
        flat = codes.ravel()
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        g["emb"] = np.zeros_like(w["emb"])
        g["emb"][seen] = np.add.reduceat(dx.reshape(-1, self.EMBED)[order], first, axis=0)
        return g

    def train(self, codes: np.ndarray, marks: np.ndarray, label: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        s = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = g.permutation(len(label))
            for a in range(0, len(order), batch):
                i = order[a : a + batch]
                logit, state = self.forward(codes[i], marks[i], keep=True)
                d = ((1 / (1 + np.exp(-logit)) - label[i]) / len(i)).astype(np.float32)
                step += 1
                for k, x in self.gradients(state, d).items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    s[k] = 0.999 * s[k] + 0.001 * x * x
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, logit: np.ndarray, label: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the largest threshold that keeps the recall."""
        a, b = 1.0, 0.0
        n1 = label.sum()
        target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            e, h = p - target, np.maximum(p * (1 - p), 1e-6)
            j = np.array([(e * logit).sum(), e.sum()])
            hess = np.array([[(h * logit * logit).sum() + 1e-3, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, j)
        self.scale, self.shift = float(a), float(b)
        p = np.sort(self.calibrated(logit)[label == 1])
        self.threshold = float(min(0.5, p[int((1 - recall) * len(p))]))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def scores(self, raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Calibrated probability of every candidate: the highest of its windows."""
        out = np.zeros(len(start))
        for a in range(0, len(start), batch):
            part = slice(a, a + batch)
            codes, marks, owner = windows(raw, offsets, start[part], end[part], row[part])
            for b in range(0, len(owner), batch):
                p = self.calibrated(self.forward(codes[b : b + batch], marks[b : b + batch]))
                np.maximum.at(out, a + owner[b : b + batch], p)
        return out


# --- labelled findings ----------------------------------------------------------------------------------------------


def labelled(n: int, seed: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """n texts with one finding each: (texts, start, end, 1 for a secret)."""
    g = random.Random(seed)
    hexes, upper32, alnum, b64 = "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    some = lambda alphabet, a, b=None: "".join(g.choice(alphabet) for _ in range(g.randint(a, b or a)))
    syllables = [some("bcdfghjklmnprstvwz", 1, 2) + g.choice("aeiouéäñ") + g.choice(["", "n", "r", "st", "nt"]) for _ in range(120)] + ["the", "of", "and", "de", "la", "und", "der", "que"]

    def word() -> str:
        w = "".join(g.choice(syllables) for _ in range(g.choice([1, 1, 2, 2, 3])))
        return (w.capitalize() if g.random() < 0.15 else w) + g.choice(["", "", "", "", "", ",", ".", ".\n", "!!", "###", "%%%", "***", "&&&", "$$$", " |"])

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def name() -> str:
        base = g.choice(["token", "api_key", "apikey", "secret", "access_token", "auth_token", "client_secret", "password", "passwd", "pwd", "pass", "secret_key", "private_key", "aws_secret_access_key", "DB_PASSWORD", "SECRET", "API-KEY", "x-api-key", "credentials", "session_key", "encryption_key"])
        return g.choice([base, base, base.upper(), f"{some(string.ascii_lowercase, 3, 6)}_{base}"])

    def assign(key: str, value: str) -> tuple[str, str]:
        form = g.choice(["{k} = \"{v}\"", "{k}={v}", "{k}: {v}", "{k}:{v}", "{k} = '{v}'", "\"{k}\": \"{v}\"", "{k} = {v}", "--{k} {v}", "export {k}={v}"])
        return form.format(k=key, v=value), value

    def plain() -> str:
        return g.choice(syllables).replace("é", "e").replace("ä", "a").replace("ñ", "n")

    def leet() -> str:
        """A word with signs and digits inside, as people choose passwords."""
        w = "".join(plain() for _ in range(g.randint(2, 3)))
        w = "".join(g.choice({"o": "0", "e": "3", "i": "1", "a": "4@", "s": "$5", "t": "7+"}.get(c, c)) if g.random() < 0.5 else c for c in w)
        w = w[0].upper() + w[1:] if g.random() < 0.7 else w
        return w + g.choice("&!#$%^*@") + some(string.digits, 1, 3) + g.choice(["", g.choice("!#$&^*") + some(string.ascii_letters, 2, 5), some(string.ascii_letters, 2, 5)])

    def password() -> str:
        return g.choice([leet(), some(alnum, 8, 20), plain().capitalize() + plain() + some(string.digits, 2, 4), some(alnum, 4, 8) + g.choice("!#$&^*") + some(alnum, 4, 8), some(hexes, 16, 32)])

    def structured(kind: int) -> tuple[str, str]:
        user, v = plain() + g.choice(["", "user", "_rw"]), password()
        host = g.choice([f"{plain()}.{plain()}.{g.choice(['com', 'net', 'org', 'de', 'fr', 'es'])}", f"{plain()}{plain()}.io", plain() + plain(), "localhost", "127.0.0.1", f"10.{g.randint(0, 255)}.0.{g.randint(1, 99)}", f"{plain()}-{g.randint(1, 9)}.{plain()}"])
        if kind == 20:
            v = v.replace("@", "!").replace("#", "!")
            scheme = g.choice(["postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "amqp", "ftp", "sftp", "https", "smtp", "ldap", "jdbc:mysql"])
            return f"{g.choice(['', '', 'url: ', 'DATABASE_URL=', 'dsn = '])}{scheme}://{g.choice([user, user, 'root', 'admin', ''])}:{v}@{host}{g.choice(['', ':5432', ':27017'])}{g.choice(['', '/', '/' + plain(), '/app?ssl=true'])}", v
        if kind == 21:
            if g.random() < 0.5:
                v = some(b64, 43, 86) + g.choice(["", "=", "=="])
                return g.choice([f"DefaultEndpointsProtocol=https;AccountName={user};AccountKey={v};EndpointSuffix=core.example.net", f"Endpoint=sb://{host}/;SharedAccessKeyName={user};SharedAccessKey={v}", f"AccountKey={v}"]), v
            v = v.replace(";", "").replace("&", "")
            return g.choice([f"Server={host};Database={plain()};User Id={user};Password={v};", f"Data Source={host};Uid={user};Pwd={v}", f"https://{host}/login?user={user}&password={v}", f"https://{host}/api?access_token={v}&page=2", f"host={plain()} port=5432 user={user} password={v} dbname={plain()}"]), v
        if kind == 22:
            return g.choice([f"curl -u {user}:{v} https://{host}/", f"-u {user}:{v}", f"--user {user}:{v}", f"{user}:{v}@{host}", f"login {user} / password {v}", f"IDENTIFIED BY '{v}'", f"requirepass {v}", f"sshpass -p {v} ssh {user}@{host}", f"mysql -u{user} -p {v}", f"PGPASSWORD={v} psql", f"{user}'s password is {v}"]), v
        if kind == 23:
            v = some(b64, 16, 60) + g.choice(["", "=", "=="])
            return g.choice([f"Authorization: Basic {v}", f"Proxy-Authorization: Basic {v}", f"Authorization: Bearer {v}", f"authorization: token {v}", f"\"auth\": \"{v}\"", f"_auth={v}", f"//registry.example.org/:_authToken={v}", f"X-Auth-Token: {v}", f"Cookie: session={v}"]), v
        v = leet()
        return g.choice([v, v, f"the old one was {v}", f"use {v} to log in", f"pw {v}"]), v

    def secret() -> tuple[str, str]:
        kind = g.randrange(25)
        if kind >= 20:
            return structured(kind)
        if kind >= 14:
            marks = "!#$%&*@^?.,;~"
            plain = "".join(g.choice(syllables).replace("é", "e").replace("ä", "a").replace("ñ", "n") for _ in range(g.randint(2, 4)))
            swapped = "".join(g.choice({"o": "0", "e": "3", "i": "1!", "a": "@4", "s": "$5", "t": "7"}.get(c, c)) if g.random() < 0.5 else c for c in plain) + g.choice(marks) + some(string.digits, 1, 3)
            v = g.choice([swapped, swapped[: g.randint(4, 6)] + g.choice(marks) + swapped[6:], plain + some(string.ascii_lowercase, 6, 8), some(alnum, 6, 7), some(alnum + marks, 6, 16), some(string.ascii_letters, 6, 16), some(alnum, 2, 5) + g.choice(marks) + some(alnum, 2, 5) + g.choice(marks) + some(alnum, 1, 4)])
            key = g.choice(["password", "passwd", "pwd", "pass", "PASSWORD", "db_password", "passphrase", "secret", "token"])
            return (g.choice(["--{k} {v}", "{k} is {v}", "the {k} was {v}", "{k} {v}"]).format(k=key, v=v), v) if g.random() < 0.5 else assign(key, v)
        if kind in (0, 12, 13):
            v = g.choice(["AKIA", "ASIA", "AROA"]) + some(upper32, 16)
            return (v, v) if g.random() < 0.8 else assign(g.choice(["aws_access_key_id", "key", "id"]), v)
        if kind == 1:
            v = g.choice(["ghp_", "gho_", "ghs_", "glpat-", "npm_", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "hf_", "AIza", "SG-", "dop_v1_", "pypi-"]) + some(alnum, 20, 48)
            return (v, v) if g.random() < 0.6 else assign(name(), v)
        if kind == 2:
            v = "eyJ" + some(b64.replace("+", "-").replace("/", "_"), 20, 120)
            return (f"Bearer {v}", v) if g.random() < 0.5 else (v, v)
        if kind == 3:
            v = "MII" + some(b64, 40, 61)
            return f"{g.choice(['', '', 'key: ', 'private_key = ', 'ssh key: '])}-----BEGIN {g.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n{v}", v
        if kind <= 6:
            return assign(name(), some(hexes, *g.choice([(32, 32), (40, 40), (40, 40), (64, 64), (16, 20), (24, 28)])))
        if kind <= 9:
            v = g.choice([some(hexes, 10, 24), some(alnum, 10, 24), some(alnum + "_-", 8, 32), g.choice(syllables).replace("é", "e").replace("ä", "a").replace("ñ", "n") + some(string.digits, 5, 8) + some(string.ascii_letters, 2, 6)])
            return assign(g.choice(["password", "passwd", "pwd", "pass", "PASSWORD", "db_password", "user_password"]), v)
        return assign(name(), some(b64, 24, 64))

    def settings(kind: int) -> tuple[str, str]:
        """Names of settings, headers, addresses and other runs with signs that give nothing away."""
        if kind <= 25:
            v = g.choice([name(), name(), "password", "Password", "AccountKey", "SharedAccessKey", "private_key", "username", "AccountName", "Authorization", "credentials", "secret", "token", "api_key", "PASSWORD", "passphrase", "clientSecret", "accessToken"])
            return g.choice([f"see: {v}", f"{word()}: {v}", f"field = {v}", f"settings: {v}{g.choice([',', '.', ''])}", f"type: \"{v}\"", f"name={v}", f"the {v}: {plain()}", f"missing {v}", f"set {v} first", f"\"key\": \"{v}\"", f"columns: {v}, {plain()}", f"reset {v}:"]), v
        if kind == 26:
            v = g.choice(["-----BEGIN", "CERTIFICATE-----", "PRIVATE", "Basic", "Bearer", "MII" + some(b64, 40, 61)])
            if v.startswith("MII"):
                return f"-----BEGIN {g.choice(['CERTIFICATE', 'PUBLIC KEY', 'CERTIFICATE REQUEST'])}-----\n{v}", v
            return {"-----BEGIN": f"{plain()}: {v} {g.choice(['CERTIFICATE', 'PUBLIC KEY', 'RSA PRIVATE KEY'])}-----", "CERTIFICATE-----": f"-----BEGIN {v}", "PRIVATE": f"{plain()}: {v} KEY", "Basic": f"Authorization: {v} {plain()}", "Bearer": f"Authorization: {v} {plain()}"}[v], v
        if kind == 27:
            host = f"{plain()}.example.{g.choice(['com', 'net', 'org'])}"
            v = g.choice([f"{some(string.digits, 4)}", f"{plain()}{some(string.digits, 1, 3)}", "true", "utf-8", "3.11", f"{g.randint(1, 99)}", "https", plain(), f"{plain()}.{plain()}"])
            return g.choice([f"https://{host}/search?q={v}&page=2", f"http://{host}:{g.randint(1000, 9999)}/x?id={v}", f"jdbc:postgresql://{host}:5432/app?user={v}", f"Server={v};Database={plain()};", f"lang={v}&sort=asc", f"host={v} port=5432", f"git@{host}:{v}", f"ssh {plain()}@{host} -p {v}"]), v
        if kind == 28:
            d = lambda a, b=None: some(string.digits, a, b)
            v = g.choice([f"v{d(1)}.{d(1, 2)}.{d(1)}-rc{d(1)}", f"{d(1, 2)}.{d(1, 3)}.{d(1, 3)}.{d(1, 3)}:{d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{plain()}({plain()}{d(1)})", f"{plain()}_{plain()}[{d(1, 2)}]", f"{d(2)}/{d(2)}/20{d(2)}", f"20{d(2)}-0{g.randint(1, 9)}-1{d(1)}T1{d(1)}:{d(2)}:{d(2)}Z", f"{plain()}{d(1, 4)}@{plain()}.{g.choice(['com', 'net', 'org', 'de'])}", f"{plain()}.{plain()}{d(0, 4)}@{plain()}.example.com", f"{plain()}.{plain()}{d(1)}.{g.choice(['py', 'txt', 'tar.gz', 'html'])}", f"/{plain()}/{plain()}{d(1, 2)}/{plain()}.{g.choice(['c', 'log'])}", f"{plain()}-{d(2)}%", f"{plain()}:{d(2, 5)}", f"{d(2)}x{d(2)}px;{plain()}", f"&#{d(4)};{plain()}", f"{plain()}{d(1)}|{plain()}{d(1)}|{plain()}{d(1)}", f"{plain()}+{plain()}={d(2)}", f"{plain().capitalize()}{d(4)}.{plain()}", f"\\{plain()}\\{plain()}{d(2)}"])
            return g.choice([v, v, f"at {v}", f"{plain()}: {v}", f"see {v}"]), v
        if kind == 29:
            v = g.choice([plain() + some(string.digits, 4, 9), some(string.digits, 6, 9) + plain(), some(string.ascii_lowercase, 8, 12) + some(string.digits, 1)])
            return g.choice([v + g.choice(["!!!", "###", ".", "?", ")", ",", "***"]), f"({v})", f"user {v}", f"{v}:"]), v
        if kind == 30:
            v = g.choice([f"{plain()}.{plain()}{g.choice(['', some(string.digits, 1, 4)])}", f"{plain()}_{plain()}", plain() + some(string.digits, 1, 4), f"{plain()}-{plain()}", f"{plain()}+{plain()}"]) + "@" + g.choice([f"{plain()}.{g.choice(['com', 'net', 'org', 'de', 'fr', 'es'])}", f"mail{some(string.digits, 1, 4)}.example.com", f"{plain()}.example.{g.choice(['com', 'org'])}"])
            return g.choice([v, v, f"mail {v}", f"contact: {v}", f"write to {v}", f"<{v}>", f"email = {v}", f"mailto:{v}"]), v
        v = g.choice(["".join(plain() for _ in range(3)) + g.choice(["'s", "!", "-" + plain()]), plain() + g.choice(["/", "|", "+", "&"]) + plain() + some(string.digits, 1, 2), plain().capitalize() + " " + plain()])
        v = v.split(" ")[-1]
        return g.choice([f"{word()}: {v}", f"{plain()} = {v}", v]), v

    def harmless() -> tuple[str, str]:
        kind = g.choice([*range(32), 0, 0, 2, 2, 4, 4, 24, 27, 28])
        if kind >= 24:
            return settings(kind)
        if kind == 20:
            v = "".join(g.choice(syllables) for _ in range(g.randint(1, 3)))
            return g.choice([f"{word()}: {v}", f"note: {v}", f"title = {v}", f"from: {v}"]), v
        if kind == 21:
            v = g.choice(["required", "the", "too", "not", "that", "of", "and", "garden", "for", "wrong", "field", "to", "reset", "invalid", "a", "in", "expired", "lost"])
            return f"{g.choice(['password', 'token', 'secret', 'pass', 'the password is', 'the secret was', 'the token is', 'credentials'])} {v}", v
        if kind == 22:
            v = some(string.digits, 1, 4)
            return g.choice([f"{some(string.digits, 1, 2)}:{v}", f"x = {v}", f"page: {v}", f"n={v}", f"{word()}: {v}"]), v
        if kind == 23:
            v = g.choice(["", "-", "_", "/"]).join(g.choice(syllables).replace("é", "e").replace("ä", "a").replace("ñ", "n") for _ in range(g.randint(6, 10)))
            return v, v
        if kind == 0:
            v = some(string.digits, 16)
            return v, v
        if kind == 1:
            v = some(string.digits, 8, 20)
            return v, v
        if kind == 2:
            v = f"{some(string.digits, 3)}-{some(string.digits, 4)}"
            return f"+{g.randint(1, 99)} ({some(string.digits, 3)}) {v}", v
        if kind == 3:
            v = f"mail{g.randint(0, 9999)}"
            return f"{g.choice(syllables)}.{some(string.digits, 2)}@{v}.example.com", v
        if kind == 4:
            v = "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
            return g.choice([f"id {v}", v, f"uuid: {v}", f"request_id={v}", *[f"{w} {v}" for w in ("request", "device", "trace", "order", "session", "build", "record", word())]]), v
        if kind <= 6:
            v = some(hexes, *g.choice([(40, 40), (40, 40), (7, 12), (64, 64), (32, 32)]))
            return g.choice(["commit ", "revision ", "sha1: ", "md5: ", "sha256:", "checksum = ", "etag: ", "tree ", "parent ", "integrity sha1-", "digest: ", "blob ", "", "hash "]) + v, v
        if kind == 7:
            v = f"{g.randint(1990, 2030)}-{g.randint(1, 12):02}-{g.randint(1, 28):02}" + g.choice(["", f"T{g.randint(0, 23):02}"])
            return v, v
        if kind == 8:
            v = f"{g.choice(['IMG', 'DSC', 'report', 'scan', 'backup', 'draft'])}_{some(string.digits, 8)}" + g.choice(["", f"_{some(string.digits, 4, 6)}"])
            return f"{v}.{g.choice(['jpg', 'pdf', 'txt'])}", v
        if kind == 9:
            v = f"{g.choice(['ORD', 'INV', 'RFC', 'ISO', 'CVE', 'SKU', 'ISBN'])}-{some(string.digits, 4)}-{some(string.digits, 3, 7)}"
            return v, v
        if kind == 10:
            v = "/".join([g.choice(syllables), g.choice(syllables) + some(string.digits, 1, 3), some(string.digits, 4, 8)])
            return f"https://{g.choice(syllables)}.example.com/{v}", v
        if kind == 11:
            v = "".join(g.choice(syllables) for _ in range(g.randint(3, 6))).replace("é", "e").replace("ä", "a").replace("ñ", "n") + some(string.digits, 1, 3)
            return v, v
        if kind <= 15:
            v = "".join(g.choice(syllables) for _ in range(g.randint(4, 8))).replace("é", "e").replace("ä", "a").replace("ñ", "n")
            return g.choice([f"{word()}: {v}", f"note: {v}", f"title = {v}", f"author: {v}", f"\"label\": \"{v}\"", f"max_tokens = {v}", f"keyword: {v}"]), v
        if kind == 16:
            v = some(string.digits, 8, 12)
            return assign(g.choice(["width", "count", "timestamp", "total", "size", "n_tokens", "offset", "zip", "customer_id"]), v)
        if kind == 17:
            v = g.choice(["deadbeef00", "0123456789", "abc12345678", "lorem-ipsum-1", "version-1-2-3", "python3-numpy1", "x86_64-linux"])
            return v, v
        if kind == 18:
            v = "/".join(str(g.randint(1, 2030)) for _ in range(3)) + some(string.digits, 1, 3)
            return v, v
        v = some(string.ascii_uppercase, 4, 12) + some(string.digits, 4, 8)
        return g.choice(["model ", "part no. ", "flight ", ""]) + v, v

    texts, start, end, label = [], [], [], []
    while len(texts) < n:
        bad = g.random() < 0.45
        shown, value = secret() if bad else harmless()
        before, after = prose(g.randint(0, 6)), prose(g.randint(0, 4))
        lead = before + g.choice([" ", " ", "\n", "; ", "("]) if before else ""
        tail = g.choice(["", " ", " ", "\n", "!! ", "### ", "%%% ", ". ", ", "]) + after
        at = len((lead + shown[: shown.rindex(value)]).encode())
        texts.append((lead + shown + tail).encode())
        start.append(at)
        end.append(at + len(value.encode()))
        label.append(int(bad))
    return texts, np.array(start), np.array(end), np.array(label)


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, marks, owner; of each candidate its text and whether it covers the finding: 1, touches it: 0, else -1; label
    of each text), as candidates() finds them."""
    texts, start, end, label = labelled(n, seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    a, b, row = candidates(raw, offsets)
    codes, marks, owner = windows(raw, offsets, a, b, row)
    first, last = (start + offsets[:-1])[row], (end + offsets[:-1])[row]
    return codes, marks, owner, row, np.where((a <= first) & (b >= last), 1, np.where((a < last) & (b > first), 0, -1)), label


@functools.lru_cache(maxsize=2)
def model(examples: int = EXAMPLES, recall: float = RECALL) -> Network:
    """Trained once a driver process, deterministically; a few tens of KB that go along with the tasks."""
    net = Network()
    codes, marks, owner, row, covers, label = _examples(examples, 1)
    known = ((covers != 0) | (label[row] == 0))[owner]
    net.train(codes[known], marks[known], ((covers == 1) & (label[row] == 1))[owner][known].astype(np.float32))
    codes, marks, owner, row, covers, label = _examples(max(500, examples // 3), 2)
    found = np.concatenate([net.forward(codes[a : a + 2048], marks[a : a + 2048]) for a in range(0, len(codes), 2048)])
    logit = np.full(len(label), -30.0)
    own = covers[owner] == 1
    np.maximum.at(logit, row[owner[own]], found[own])
    net.calibrate(logit, label, recall)
    return net


def scan(raw: np.ndarray, offsets: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, probability, flagged) of every candidate, in order; flagged spans do not overlap."""
    start, end, row = candidates(raw, offsets)
    p = net.scores(raw, offsets, start, end, row)
    bad = np.flatnonzero(p >= net.threshold)
    flagged = np.zeros(len(start), bool)
    flagged[bad[outermost(start[bad], end[bad])]] = True
    return start, end, row, p, flagged


FINDINGS = "array<struct<at:int,length:int,probability:double>>"


def findings(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, length, probability) of every secret; at counts bytes of the UTF-8 text. No shuffle. The secret
    itself is not in the result."""
    net = net or model()

    def run(batches):
        for batch in batches:
            raw_all, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                part = offsets[a : b + 1] - offsets[a]
                start, end, row, p, bad = scan(raw_all[offsets[a] : offsets[b]], part, net)
                start, end, row, p = start[bad], end[bad], row[bad], p[bad]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(start - part[row]), pa.array(end - start), pa.array(p)], ["doc_id", "at", "length", "probability"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, at bigint, length bigint, probability double")


def redacted(text: Column, net: Network | None = None) -> Column:
    """The text with every secret replaced by MASK; null stays null."""
    net = net or model()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        raw, offsets = utf8(column)
        parts: dict[int, list[tuple[int, int]]] = {}
        for a, b in slices(offsets, 1 << 20):
            start, end, row, _, bad = scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], net)
            for s, e, r in zip(start[bad].tolist(), end[bad].tolist(), row[bad].tolist()):
                parts.setdefault(r + a, []).append((s + int(offsets[a]), e + int(offsets[a])))
        if not parts:
            return column.cast(pa.string())
        out = column.to_pylist()
        data = raw.tobytes()
        for r, spans in parts.items():
            made, at = [], int(offsets[r])
            for s, e in spans:
                made += [data[at:s], MASK]
                at = e
            out[r] = b"".join([*made, data[at : int(offsets[r + 1])]]).decode()
        return pa.array(out, pa.string())

    return run(text.cast("string"))


def redact(docs: DataFrame, net: Network | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with the secrets masked in the text and, where there is such a column, the number of characters adjusted
    (a null number stays null). All rows and columns stay."""
    bounded_batches(docs.sparkSession)
    name = "__masked"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, redacted(F.col(text_col), net))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(name).alias(c))
        elif size_col and c == size_col:
            changed = F.col(name) != F.col(text_col)
            columns.append(F.when(changed & F.col(c).isNotNull(), F.length(name).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
