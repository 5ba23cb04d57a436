"""What databases can do about sampling, as one record a dialect, and one builder of SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import SamplingNotSupported
from ..operators.sampling import share


@dataclass(frozen=True)
class Dialect:
    """``draw`` is a random number, below ``scale`` times the share for a sampled row; ``seeded`` has a place for a seed.

    ``prepare`` is a statement that seeds a connection; ``clause`` samples a
    table natively, ``repeat`` makes that repeatable.  None: there is no such thing.
    """

    name: str
    draw: str
    scale: int = 1
    seeded: str | None = None
    prepare: str | None = None
    clause: str | None = None
    repeat: str = ""
    methods: tuple[str, ...] = ()
    quote: str = '"'
    driver: str | None = None
    order: str | None = None

    def keeps(self, fraction: float, seed: int | None) -> str:
        """A predicate that is true for a share of rows."""
        draw = self.draw
        if seed is not None and self.prepare is None:
            if self.seeded is None:
                raise SamplingNotSupported(f"{self.name} draws no repeatable random numbers, so a seed cannot be honoured")
            draw = self.seeded.format(seed=int(seed))
        bound = share(fraction) if self.scale == 1 else int(share(fraction) * self.scale)
        return f"{draw} < {bound!r}"

    def quoted(self, name: str) -> str:
        """A name, possibly with a schema, in this dialect's quotes."""
        return ".".join(f"{self.quote}{part.replace(self.quote, 2 * self.quote)}{self.quote}" for part in name.split("."))


_MYSQL = {"draw": "rand()", "seeded": "rand({seed})", "quote": "`"}
DIALECTS = {
    d.name: d
    for d in (
        Dialect("postgresql", "random()", prepare="SELECT setseed({unit!r})", clause="TABLESAMPLE {method} ({percent!r})", repeat=" REPEATABLE ({seed})", methods=("SYSTEM", "BERNOULLI"), driver="org.postgresql.Driver"),
        Dialect("mysql", **_MYSQL, driver="com.mysql.cj.jdbc.Driver"),
        Dialect("mariadb", **_MYSQL, driver="org.mariadb.jdbc.Driver"),
        Dialect("sqlite", "(random() & 2147483647)", scale=1 << 31, order="random()", driver="org.sqlite.JDBC"),
        Dialect("clickhouse", "randCanonical()", clause="SAMPLE {share!r}", quote="`", driver="com.clickhouse.jdbc.ClickHouseDriver"),
    )
}


def dialect_of(name: str) -> Dialect:
    try:
        return DIALECTS[name]
    except KeyError:
        raise SamplingNotSupported(f"nothing is known about sampling in {name!r}; known are {', '.join(DIALECTS)}") from None


def sampled_query(name: str, query: str, fraction: float, seed: int | None = None) -> tuple[str | None, str]:
    """A statement that prepares the connection, or None, and a query for a share of another query's rows."""
    dialect, prepare = dialect_of(name), None
    if seed is not None and dialect.prepare:
        prepare = dialect.prepare.format(unit=(seed * 2654435761 % 2**32) / 2**31 - 1)
    return prepare, f"SELECT * FROM ({query}) AS sampled WHERE {dialect.keeps(fraction, seed)}"


def random_batch(name: str, query: str, rows: int) -> str:
    """A query for some random rows of another query, drawn anew each time."""
    if rows < 1:
        raise ValueError(f"a batch has one row at least; this has {rows}")
    dialect = dialect_of(name)
    return f"SELECT * FROM ({query}) AS batch ORDER BY {dialect.order or dialect.draw} LIMIT {int(rows)}"


def sampled_table(name: str, table: str, column: str, fraction: float, seed: int | None = None, method: str = "system", where: str | None = None) -> str:
    """A query for a share of a table's column, sampled natively where the database can, else by a predicate."""
    dialect = dialect_of(name)
    part, wanted = share(fraction), method.upper()
    source, tests = dialect.quoted(table), [f"({where})"] if where else []
    if dialect.methods and wanted not in dialect.methods:
        raise ValueError(f"{name} samples tables by {' or '.join(dialect.methods).lower()}, not by {method}")
    if dialect.clause:
        if seed is not None and not dialect.repeat:
            raise SamplingNotSupported(f"{name} samples tables without a seed")
        source += f" {dialect.clause.format(method=wanted, percent=100 * part, share=part)}"
        source += dialect.repeat.format(seed=int(seed)) if seed is not None else ""
    else:
        tests.append(dialect.keeps(part, seed))
    return f"SELECT {dialect.quoted(column)} FROM {source}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
