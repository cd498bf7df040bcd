"""Statistics of document texts that tell running prose from lists, tables, code and junk.

Every line, seen with its neighbours of the same paragraph, gives two distributions: over kinds of words (function words
of each language, other words, numbers, identifiers, ...) and over character classes. The line takes the structure of
the nearest profile by Jensen-Shannon divergence. Profiles are computed from the short example texts below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it as with on by this be are from at which or an but not when there were each our we while because although should also so if during then was has have had its one can into than their would will i you they he she what who just like really about more",
    "de": "der die das und in den von zu mit ist nicht des auf im dem sich ein eine einen es für als auch an nach bei aus werden wird weil aber obwohl am vor ohne über zum zur wie wenn noch nur wir ich sie er man hat war sind",
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au aux par avec sans avant après mais il elle ce cette plus nous vous je on ne se son sa ses ou comme était sont",
    "es": "el la los las de y en un una que es por con para del al se no su lo más sin antes después aunque pero como muy ya o este esta fue son hay nos sus porque cuando",
}
CJK_FUNCTION = "的了在是和不而但且因为这那有就也都与之其被把对从到以并或若虽然所可会能将则"
# Example texts of each structure, from which the profiles are computed.
EXAMPLES = [
    ("prose", "The old bridge was closed in the spring because the river had risen, and nobody could say when it would open again. We waited for a boat at the landing, although the ferry of the second company had stopped running. There were 14 people in the queue by 9.30 am. Local traders that depend on the crossing should also lose some of their weekly trade."),
    ("prose", "so basically i think the bus is late again and you know we just stand there like every day\nanyone else had this with the new timetable they put up lol\num right so what happened was that they moved the stop to the other side of the road and it took us an hour"),
    ("prose", "An unusually cold winter delays the planting of early vegetables in northern gardens. Steady regional demand supports small local growers despite higher seasonal costs. Each rainy week cuts the open-air market by 4.5 percent, and dry sunny weeks raise late summer harvests."),
    ("prose", "Der Zug hält am frühen Morgen nur an der alten Brücke, weil die Strecke im Winter nicht befahren wird. Die Reisenden warten mit dem Gepäck vor dem Bahnhof, obwohl der Bus schon um 8 Uhr fährt. Das Wetter verbessert die Lage ohne weitere Hilfe."),
    ("prose", "Le train s'arrête à la vieille gare avant la nuit, mais les voyageurs attendent sur le quai avec leurs valises. La pluie retarde les départs de 12 % en fin de semaine, et le vent réduit la visibilité pour la plupart des conducteurs."),
    ("prose", "El tren llega a la estación antigua por la mañana, pero los viajeros esperan en el andén con sus maletas. La lluvia retrasa las salidas un 12 % a fin de mes, y el viento reduce la visibilidad para la mayoría de los conductores."),
    ("prose", "在这个冬天，火车因为大雪而晚点，但是旅客们仍然在车站等候。河水上涨了三成，而且桥梁的维修还没有完成。虽然价格下降了，市场的需求却保持稳定。"),
    ("list", "- wooden boats\n- coastal railway\n- garden tools\n- quiet valley\n* painted doors\n* winter coats"),
    ("list", "1. Bridge (northern towns)\n2. Harbour (small islands)\n3. Lighthouse (western coast)\n14. Station (mountain lines)"),
    ("list", "Steady Rivers and Quiet Valleys in Northern Towns, 2004, pp. 21–144\nOn Early Harvests and the Weather in Coastal Gardens, 1998, pp. 105–212\nDoes the Winter Ferry Delay Travellers? Evidence from Island Ports, 2011, pp. 88–301"),
    ("list", "* The Quiet Harbour https://boats.example/harbour/4412\n* A Painted Door of Old Houses https://doors.example/house/871\n* Our Lighthouse https://coast.example/light/65"),
    ("list", "Home\nContact\nGallery\nPartners\nTickets\nKontakt\nAccueil\nInicio\nGalerie\nPresse\nWetter\nEntradas"),
    ("list", "QRWT 24.10 +1.7%\nLKPA 111.05 -0.3%\nMNVB 9.71 +0.2%\nZXCD 140.66 -2.1%"),
    ("table", "name\tlength\twidth\tdepth\nferry\t-12.5\t4.1\t8.0\nbarge\t33.0\t-6.2\t2.4\ncanoe\t5.5\t0.9\t-0.4"),
    ("table", "name;length;width;depth\nferry;-12;4;8\nbarge;33;-6;2\nname,length,width,depth\nferry,-12.5,4.1,8.0\nlong-boat,33.0,-6.2,2.4"),
    ("table", "| name | length | width | depth |\n|---|---|---|---|\n| ferry | -12 | 41 | 80 |\n| barge | 33 | -62 | 24 |"),
    ("table", "ferry                     -378.32     -367.92     1654.84\nbarge                    1674.86     -872.09     1000.33\nlong-boat                -106.87      144.00     1258.71"),
    ("code", "def ferry_route(x, *args):\n    return harbour[2:]\nfor i in range(120):\n    if width > 0.55:\n        boat_length = barge(45, n=7)\nimport os\nclass Boat:\n    x = {}"),
    ("code", '  {"ferry": 5.8625, "barge": "canoe", "ok": false},\n  {"harbour": -2.41, "bridge": "river", "ok": true},\n</div><p class="x">&nbsp;</p>\nif (x == 0) { return y; }'),
    ("code", "2024-03-11 02:12:22,285 DEBUG [ferry-3] harbour.bridge id=27c3b448 ms=709\n2024-03-12 04:16:22,698 WARN [barge-1] canoe.river id=e83e3ace ms=12"),
    ("junk", "wooden boats, season tickets, garden tools, river ferries, winter coats, harbour lights, mountain lines, island ports,\nferry bridges, coastal towns, market stalls, early harvests, painted doors,"),
    ("junk", "#ferry #harbour #bridge #canoe #river #boats\n#winter #island #market #garden"),
    ("junk", "RTsc/rH9FrDrSMoRfCq47eIhhzCLejt0CBu+FGiq6JhWEe5w9Qesw9YeZ3VhT7S6mz83rph8\nrAArTno8kReZ66CQ4xzRy077ws/dI1SjRAkJVOXBdd74MVUXzSveL25WeeYaQL9HlW94NqEl"),
    ("junk", "Th_ o^d*br§dge |as \\cl=sed i~ t%e s@ring ¬ec<use t&e r/ver =ad >isen a|d n@body \\ould s~y wh_n it^wo*ld op%n ag§in. W= w@it¬d fo| a bo~t at^the"),
    ("junk", "ferryferryferryferryferryferry\n=-=-=-=-=-=-=-=-=-\nharbourharbourharbourharbour\n******** ________ ~~~~~~~~"),
]
TOKEN_KINDS = ("fn_en", "fn_de", "fn_fr", "fn_es", "fn_shared", "lower", "capital", "upper", "tag", "url", "number", "mixed", "symbol", "cjk", "long", "clause_end", "sentence_end")
CHAR_KINDS = ("lower", "upper", "digit", "space", "stop", "comma", "quote", "bracket", "dash", "symbol", "accent", "cjk", "cjk_function", "cjk_stop", "odd")
STATS_SCHEMA = (
    "doc_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, "
    "end_punctuation_share double, common_word_share double, prose_share double, structure string, divergence double"
)
K, C = len(TOKEN_KINDS), len(CHAR_KINDS)


def _char_table() -> np.ndarray:
    table = np.full(0x10000, CHAR_KINDS.index("odd"), np.uint8)
    at = {k: i for i, k in enumerate(CHAR_KINDS)}
    for code in range(0x10000):
        c = chr(code)
        if c.isspace():
            kind = "space"
        elif "a" <= c <= "z":
            kind = "lower"
        elif "A" <= c <= "Z":
            kind = "upper"
        elif "0" <= c <= "9":
            kind = "digit"
        elif c in ".!?…":
            kind = "stop"
        elif c in ",;:":
            kind = "comma"
        elif c in "'\"’‘“”„«»´":
            kind = "quote"
        elif c in "()[]{}<>":
            kind = "bracket"
        elif c in "-–—‐‑":
            kind = "dash"
        elif c in CJK_FUNCTION:
            kind = "cjk_function"
        elif c in "，。、！？；：「」":
            kind = "cjk_stop"
        elif 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3:
            kind = "cjk"
        elif c.isalpha():
            kind = "accent"
        elif 33 <= code < 127 or code in (0xA7, 0xA6, 0xAC, 0xB7, 0x2022, 0x2248):
            kind = "symbol"
        else:
            continue
        table[code] = at[kind]
    return table


class TokenKinds(dict):
    """Kind of each token, remembered up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        sets = {lang: set(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
        self.words = {w: TOKEN_KINDS.index("fn_shared" if sum(w in s for s in sets.values()) > 1 else f"fn_{lang}") for lang, s in sets.items() for w in s}

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = TOKEN_KINDS.index(kind) if isinstance(kind := self.kind(token), str) else kind
        return value

    def kind(self, token: str) -> int | str:
        bare = token.strip(".,;:!?…\"'“”„«»()[]’‘")
        low = bare.lower()
        if low in self.words:
            return self.words[low]
        if "://" in token or low.startswith("www.") or re.fullmatch(r"\S+@\S+\.\w+", bare):
            return "url"
        if token[:1] in "#@" and len(token) > 1:
            return "tag"
        if re.search(r"[぀-ヿ㐀-鿿]", token):
            return "cjk"
        if not bare or not any(c.isalnum() for c in bare):
            return "symbol"
        if re.fullmatch(r"[+\-−]?[\d.,:/–\-]+[%a-z]{0,2}", bare):
            return "number"
        core = re.sub(r"['’]", "", bare)
        if not all(p.isalpha() for p in core.split("-")):
            return "mixed"
        if len(bare) > 24:
            return "long"
        if re.search(r"[.!?…][\"'”’)»]*$", token):
            return "sentence_end"
        if token[-1] in ",;:":
            return "clause_end"
        if bare.isupper() and len(bare) > 1:
            return "upper"
        if bare[0].isupper() and bare[1:].islower() or "-" in bare and bare[0].isupper():
            return "capital"
        return "lower" if bare.islower() else "mixed"



BROKEN = re.compile(r"[Â-ô][\u0080-¿Œ-™]")


def _repaired_line(line: str) -> str:
    if BROKEN.search(line) and sum(c > "\x7f" for c in line) * 2 <= len(line):
        for codec in ("latin-1", "cp1252"):
            try:
                return line.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return line


def repaired(text: str) -> str:
    """``text`` with UTF-8 undone that was once read as Latin-1 or Windows-1252, in lines where that is possible throughout. A
    line of which such signs are the larger part stays: nobody can read it, so it is no prose as it stands."""
    return "\n".join(map(_repaired_line, text.split("\n"))) if BROKEN.search(text) else text


CHUNK = 1 << 20
PROSE_LINE = np.array([n.startswith("fn_") for n in TOKEN_KINDS])
END_CODES = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"'”’)]»"], np.uint32)


def lowered(text: str) -> str:
    """``text`` with its lines of capitals only in lower case, where they hold several words."""
    if not re.search(r"[A-ZÀ-Þ]{4}[^a-z]{12}", text):
        return text
    return "\n".join(line.lower() if line.isupper() and sum(len(w) > 2 for w in line.split()) >= 4 else line for line in text.split("\n"))


def line_counts(text: str, kinds: TokenKinds, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: counts of token kinds, counts of character kinds, and whether it ends in end punctuation."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = table[np.minimum(codes, 0xFFFF)].astype(np.int64)
    line = np.cumsum(codes == 10)
    n = int(line[-1]) + 1
    space = cls == CHAR_KINDS.index("space")
    starts = ~space & np.concatenate(([True], space[:-1]))
    tokens = text.split()
    kind = np.fromiter(map(kinds.__getitem__, tokens), np.int64, len(tokens))
    per_token = np.bincount(line[starts] * K + kind, minlength=n * K).reshape(n, K).astype(np.float32)
    inner = codes != 10
    per_char = np.bincount(line[inner] * C + cls[inner], minlength=n * C).reshape(n, C).astype(np.float32)
    solid = np.flatnonzero(~space)
    last = np.zeros(n, np.int64)
    last[line[solid]] = solid
    end = np.isin(codes[last], END_CODES) | (np.isin(codes[last], CLOSERS) & np.isin(codes[np.maximum(last - 1, 0)], END_CODES))
    return per_token, per_char, end & (per_token.sum(axis=1) > 0)


def _plogp(p: np.ndarray) -> np.ndarray:
    return np.einsum("...k,...k->...", p, np.log2(p + np.float32(1e-30)))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from each row of ``q``."""
    own, other = _plogp(p), _plogp(q)
    return np.stack([(own + o) / 2 - _plogp((p + row) / 2) for row, o in zip(q, other, strict=True)], axis=1)


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.where(total > 0, total, np.float32(1))


class Profiles:
    def __init__(self) -> None:
        self.kinds, self.table = TokenKinds(), _char_table()
        self.names = np.array([name for name, _ in EXAMPLES])
        counts = [tuple(x.sum(axis=0) for x in line_counts(text, self.kinds, self.table)[:2]) for _, text in EXAMPLES]
        self.tokens, self.chars = _shares(np.array([t for t, _ in counts])), _shares(np.array([c for _, c in counts]))
        self.structures = list(dict.fromkeys(self.names))
        self.of = np.array([self.structures.index(n) for n in self.names])

    def lines(self, tokens: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Divergence of each line from each profile, seen with its neighbours up to a blank line."""
        blank = tokens.sum(axis=1, keepdims=True) == 0
        out = []
        for x in (tokens, chars):
            x = np.where(blank, np.float32(0), x)
            wide = 2 * x
            wide[1:] += x[:-1]
            wide[:-1] += x[1:]
            out.append(_shares(wide))
        return divergence(out[0], self.tokens) + divergence(out[1], self.chars)


def describe(texts: list[str], profiles: Profiles) -> dict[str, np.ndarray | list]:
    """The statistics of each text, by their names in STATS_SCHEMA."""
    texts = [lowered(repaired(t)).replace("\r\n", "\n") for t in texts]
    per_text = np.array([t.count("\n") + 2 for t in texts])  # a blank line parts the texts
    doc = np.repeat(np.arange(len(texts)), per_text)
    tokens, chars, end = line_counts("\n\n".join(texts) + "\n", profiles.kinds, profiles.table)
    solid = np.flatnonzero(tokens.sum(axis=1) > 0)
    n = len(texts)
    total = lambda x, at=slice(None): np.bincount(doc[at], x[at].astype(np.float64), n)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    apart = profiles.lines(tokens, chars)[solid]
    nearest = apart.argmin(axis=1)
    weight = chars[solid].sum(axis=1)
    by = np.bincount(doc[solid] * len(profiles.structures) + profiles.of[nearest], weight, n * len(profiles.structures)).reshape(n, -1)
    used = by.sum(axis=1)
    words, size, lines = total(tokens.sum(axis=1)), total(chars.sum(axis=1)), np.bincount(doc[solid], minlength=n)
    at = {k: i for i, k in enumerate(CHAR_KINDS)}
    pick = lambda *names: total(chars[:, [at[k] for k in names]].sum(axis=1))
    prose = profiles.structures.index("prose")
    share = by / np.where(used > 0, used, 1)[:, None]
    rest = np.where(np.arange(len(profiles.structures)) == prose, -1, share).argmax(axis=1)
    named = np.where(share[:, prose] >= 0.5, prose, rest)
    return {
        "n_words": words.astype(np.int64),
        "mean_word_length": over(pick("lower", "upper", "accent", "cjk", "cjk_function"), words),
        "symbol_ratio": over(pick("bracket", "symbol", "odd"), size),
        "digit_ratio": over(pick("digit"), size),
        "n_lines": lines,
        "end_punctuation_share": over(total(end), lines.astype(np.float64)),
        "common_word_share": over(total(tokens[:, PROSE_LINE].sum(axis=1)), words),
        "prose_share": share[:, prose],
        "structure": [profiles.structures[k] if u > 0 else "junk" for k, u in zip(named, used, strict=True)],
        "divergence": over(np.bincount(doc[solid], apart.min(axis=1) * weight, n), used),
    }


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    profiles = Profiles()
    columns = [c.split()[0] for c in STATS_SCHEMA.split(", ")]
    for pdf in batches:
        texts = ["" if t is None else t for t in pdf["text"]]
        sizes = np.array([len(t) for t in texts], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1 if len(texts) else []
        for part in np.split(np.arange(len(texts)), cuts):
            if len(part):
                found = describe([texts[i] for i in part], profiles)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[part], "n_chars": sizes[part], **found})[columns]


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics for each row of ``documents`` (doc_id, text); see STATS_SCHEMA.

    prose_share is the share of the characters of non-blank lines that stand in lines whose nearest profile is prose;
    structure is prose from one half on, else the structure with the largest share. Null and blank texts count as junk
    without prose; repeated rows are described each; an empty table gives no rows; other columns are ignored. Texts are
    read whole, and no row is moved: there is no shuffle.
    """
    return documents.select("doc_id", "text").mapInPandas(_statistics, STATS_SCHEMA)
