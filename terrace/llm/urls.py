"""URL filter: rules first, then logistic regression on character n-grams.

Hosts and paths give hashed n-grams of three to five characters, those of the
host apart from those of the path. A small table of labelled URLs, given with
the operator, trains the weights on the driver; scoring is one map that reads
only the url column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

DIMENSIONS, SIZES, EPOCHS, RATE, PENALTY = 1 << 14, (3, 4, 5), 200, 0.5, 1e-3
LOWER = {c: c + 32 for c in range(65, 91)}

#: The labelled URL table.
BLOCKED = """
http://best-casino-bonus.example/win http://free-casino.example/slots/spin http://poker-online.example/bonus http://cheap-pills.example/buy/viagra
http://xxx-videos.example/watch http://hot-adult-chat.example/live http://porn-tube.example/free http://sexcam.example/rooms
http://warez-crack.example/keygen http://free-torrents.example/download/movie http://cracked-apps.example/apk http://serials.example/keygen/all
http://click-track.example/ads/banner http://ads.example/pixel.gif http://doubleads.example/click?id=9 http://popunder.example/ad/serve
http://win-a-prize.example/claim http://lottery-winner.example/claim/now http://make-money-fast.example/work http://bitcoin-doubler.example/invest
http://login-verify.example/account/update http://secure-paypa1.example/signin http://bank-alert.example/verify/password http://free-gift-card.example/survey
http://replica-watches.example/shop/cheap http://payday-loan.example/apply/fast http://miracle-diet.example/order http://escort-girls.example/city
""".split()
ALLOWED = """
https://www.university.example/research/papers https://library.example/catalogue/item/12 https://news.example/world/2024/report https://docs.example/guide/install
https://blog.example/en/825 https://wiki.example/en/history https://museum.example/es/coleccion https://school.example/fr/cours/1
https://city.example/de/rathaus/plan https://weather.example/forecast/today https://recipes.example/bread/rye https://garden.example/plants/roses
https://forum.example/topic/77.html https://code.example/project/readme https://archive.example/page/2 https://journal.example/volume/3/article/5
https://m.example/en/25 https://health.example/advice/sleep https://travel.example/guide/coast https://books.example/review/novel
https://science.example/physics/light https://music.example/album/1 https://www.example/en/853/ https://kids.example/stories/fox
https://law.example/statutes/section/4 https://maps.example/region/north https://tv.example/programme/list https://sport.example/results/league
""".split()


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((n for c in "/?#" if (n := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((n for c in "?#" if (n := rest.find(c)) >= 0), default=len(rest))
    return host.translate(LOWER), rest[:end]


class Rules:
    """Rules like ``example.com/en/``: a host with all its subdomains, and how the path starts. The longest that fits decides."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


def features(host: str, path: str) -> np.ndarray:
    """Slots of the n-grams, repeats included."""
    out = []
    for name, s in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        out += [zlib.crc32(f"{name}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % DIMENSIONS for n in SIZES for i in range(len(s) - n + 1)]
    return np.array(out, np.int64)


def train(labelled: list[tuple[str, int]]) -> np.ndarray:
    """Weights, with the bias last, of logistic regression by full gradient steps; 1 is to be blocked."""
    x = np.zeros((len(labelled), DIMENSIONS + 1))
    for row, (url, _) in zip(x, labelled):
        slots = features(*parts(url))
        np.add.at(row, slots, 1.0 / max(1, len(slots)) ** 0.5)
        row[-1] = 1.0
    y, w = np.array([label for _, label in labelled], np.float64), np.zeros(DIMENSIONS + 1)
    for _ in range(EPOCHS if len(labelled) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        step = x.T @ (p - y) / len(y) + PENALTY * np.append(w[:-1], 0)
        w -= RATE * step * 4
    return w


def probability(w: np.ndarray, host: str, path: str) -> float:
    """How likely the URL is to be blocked; the bias alone speaks for an empty one."""
    slots = features(host, path)
    return float(1 / (1 + np.exp(-(w[slots].sum() / max(1, len(slots)) ** 0.5 + w[-1]))))


def judge(df: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score for every row.

    ``rule`` is null where none fits; then a probability of at least one half
    blocks. ``score`` is that probability for every row. A null url, or one without ``://``, has an
    empty host and path, which no rule fits. Null and repeated ids each give a row; an empty table gives none;
    other columns are not read.
    """
    if labelled is None:
        labelled = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]
    weights, table = train(labelled), Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                rows = []
                for url in part.column(1).to_pylist():
                    host, path = parts(url)
                    found, p = table.match(host, path), probability(weights, host, path)
                    rows.append((host, path, found and found[0], found[1] if found else "block" if p >= 0.5 else "allow", p))
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 4, pa.float64()]))], names=[part.schema.names[0], "host", "path", "rule", "verdict", "score"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, score double")
