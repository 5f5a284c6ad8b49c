"""ARFF files with one relational attribute, read as bags and written back.

A file is a header (attribute lines; those between `@attribute <bag> relational` and `@end <bag>` describe the
instances) and, after the first line `@data`, a line for each bag: id, quoted instances separated by a literal
backslash-n, class. Lines are parsed by columns; only the header's lines go to the driver. The first column is the id
whatever its name; the bag and class columns are found by name. `%` lines and blank lines are skipped.

Instances are vectors of doubles: numbers as they are, a nominal value as its place in the domain (from 0), `?` and
strings as NaN. If some attribute is no number, bags have a column `texts` with all values as they stand in the file.
Scalers leave dimensions that are no numbers alone, and `Dataset.numeric` keeps only the others.

Repeated groups in the pattern of a field are possessive, so that a line of any length is matched without recursion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import put
from ..operators.ranking import with_rank

BAGS = "pos long, bag_id string, label string, instances array<array<double>>"
ATTRIBUTES = "idx int, name string, attr_type string, values array<string>"
_FIELD = r"""\s*+("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^,]*+)\s*+(?:,|$)"""
#: Type names that count as numbers.
NUMERIC = ("real", "integer", "numeric", "float", "int")


@dataclass(frozen=True)
class Attribute:
    """A column of the instances: name, type (real, integer, string, nominal, date) and a nominal's domain."""

    name: str
    attr_type: str
    values: tuple[str, ...] = ()
    data_format: str | None = None
    val_range: tuple[float, float] | None = None

    @property
    def is_numeric(self) -> bool:
        return self.attr_type.strip().lower() in NUMERIC

    def accepts(self, value) -> bool:
        """Whether a Python value fits the type: whole numbers for integer, numbers for real, texts for string and (of the domain) for nominal."""
        kind = self.attr_type.strip().lower()
        if kind in ("integer", "int"):
            return isinstance(value, int)
        if kind in NUMERIC:
            return isinstance(value, (int, float))
        if kind == "string":
            return isinstance(value, str)
        return isinstance(value, str) and value in self.values if kind == "nominal" else True

    def coded(self, value) -> float:
        """A value that the type accepts, as it stands in vectors."""
        if not self.accepts(value):
            raise TypeError(f"{value!r} is no value of the {self.attr_type} attribute {self.name!r}")
        return float(self.values.index(value)) if self.attr_type == "nominal" else float("nan") if isinstance(value, str) else float(value)


@dataclass
class Dataset:
    """Bags with their name and attributes."""

    name: str
    bags: DataFrame
    attributes: list[Attribute]

    def attribute_table(self) -> DataFrame:
        rows = [(i, a.name, a.attr_type, list(a.values)) for i, a in enumerate(self.attributes)]
        return self.bags.sparkSession.createDataFrame(rows, ATTRIBUTES)

    def equals(self, other: Dataset) -> bool:
        """Same name, same attributes and, in order, the same bags."""
        a, b = (d.bags.select("pos", "bag_id", "label", "instances") for d in (self, other))
        return self.name == other.name and self.attributes == other.attributes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __iter__(self) -> Iterator[Row]:
        """Bags in order, one partition at a time."""
        return self.bags.orderBy("pos").toLocalIterator()

    def __contains__(self, bag_id: str) -> bool:
        return not self.bags.where(F.col("bag_id") == str(bag_id)).isEmpty()

    def __len__(self) -> int:
        return self.bags.count()

    @property
    def numeric_dimensions(self) -> list[int]:
        return [i for i, a in enumerate(self.attributes) if a.is_numeric]

    def numeric(self) -> Dataset:
        """Only the dimensions that are numbers, as distances need them."""
        kept = self.numeric_dimensions
        if len(kept) == len(self.attributes):
            return self
        vectors = F.transform("instances", lambda p: F.array(*[F.get(p, k) for k in kept]))
        return Dataset(self.name, self.bags.withColumn("instances", vectors), [self.attributes[k] for k in kept])

    def with_value(self, bag_id: str, instance: int, k: int, value) -> Dataset:
        """One value set: TypeError if the attribute does not take it, IndexError if there is no such attribute; a bag without such an instance raises when read."""
        if not 0 <= k < len(self.attributes):
            raise IndexError(f"no attribute {k}")
        code = F.lit(self.attributes[k].coded(value))
        here = F.when((F.lit(instance) < 0) | (F.lit(instance) >= F.size("instances")), F.raise_error(F.lit(f"no instance {instance}")).cast("array<array<double>>"))
        changed = here.otherwise(F.transform("instances", lambda p, i: F.when(i == instance, put(p, k, code)).otherwise(p)))
        bags = self.bags.withColumn("instances", F.when(F.col("bag_id") == bag_id, changed).otherwise(F.col("instances")))
        if "texts" in bags.columns:
            text = F.transform("texts", lambda p, i: F.transform(p, lambda v, j: F.when((i == instance) & (j == k), F.lit(str(value))).otherwise(v)))
            bags = bags.withColumn("texts", F.when(F.col("bag_id") == bag_id, text).otherwise(F.col("texts")))
        return Dataset(self.name, bags, self.attributes)

    def __repr__(self) -> str:
        return f"Dataset({self.name!r}, {len(self.attributes)} attributes)"


def attributes_of(df: DataFrame) -> list[Attribute]:
    """The columns of a table as attributes: whole numbers are integer, other numbers real, dates and times date, all else string."""
    kind = lambda t: "integer" if isinstance(t, T.IntegralType) else "real" if isinstance(t, T.NumericType) else "date" if isinstance(t, (T.DateType, T.DatetimeType)) else "string"
    return [Attribute(f.name, kind(f.dataType)) for f in df.schema]


def attribute_of(line: str) -> tuple[str, Attribute] | None:
    """The name and descriptor of an attribute line; None if it says nothing of use."""
    m = re.match(r"""@attribute\s+("[^"]*"|'[^']*'|\S+)\s+(.+?)\s*$""", line.strip(), re.I)
    if not m:
        return None
    name, kind = m[1].strip("\"'"), m[2]
    if kind.startswith("{"):
        return name, Attribute(name, "nominal", tuple(v.strip().strip("\"'") for v in kind.strip("{}").split(",")))
    word = kind.split()[0].lower()
    known = {"numeric": "real", "real": "real", "float": "real", "double": "real", "integer": "integer", "int": "integer", "string": "string", "relational": "relational"}
    if word == "date":
        return name, Attribute(name, "date", data_format=kind[4:].strip().strip("\"'") or None)
    return (name, Attribute(name, known[word])) if word in known else (name, Attribute(name, "real"))


def header_of(lines: list[str], bag_column: str, class_column: str) -> tuple[list[str], list[Attribute]]:
    """Column names in order, and the attributes of the instances."""
    columns, inner, inside = [], [], False
    for line in (x.strip() for x in lines):
        if inside:
            if line.lower().startswith("@end"):
                inside = False
            elif found := attribute_of(line):
                inner.append(found[1])
        elif found := attribute_of(line):
            columns.append(found[0])
            inside = found[1].attr_type == "relational" and found[0] == bag_column
    if len(columns) < 3:
        raise ValueError(f"an ARFF file of bags needs an id, a bag and a class column; found {columns}")
    for name in (bag_column, class_column):
        if name not in columns:
            raise ValueError(f"no column {name!r} among {columns}")
    if not inner:
        raise ValueError(f"the relational attribute {bag_column!r} has no attributes")
    if other := [a.name for a in inner if a.attr_type in ("date", "relational")]:
        raise ValueError(f"instance attributes cannot be dates or relational: {other}")
    return columns, inner


def _unquoted(field: Column) -> Column:
    """Without the quotes at both ends, if they are alike; inside them a quote stands behind a backslash."""
    text = F.trim(field)
    mark, inside = F.substring(text, 1, 1), F.substring(text, F.lit(2), F.length(text) - 2)
    both = (F.length(text) > 1) & mark.isin("'", '"') & (mark == F.substring(text, -1, 1))
    return F.when(both, F.regexp_replace(inside, r"""\\(['"])""", "$1")).otherwise(text)


def texts_of(payload: Column) -> Column:
    """The values, as texts, of a payload whose instances are separated by a literal backslash-n."""
    rows = F.filter(F.split(payload, r"\\n|\n"), lambda r: F.trim(r) != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, ","), lambda v: F.trim(v)))


def instances_of(texts: Column, attributes: list[Attribute]) -> Column:
    """Vectors of texts. What is no number where one should be, or not in its domain, raises."""
    number = lambda v: F.when(v == "?", F.lit(float("nan"))).otherwise(v.cast("double"))
    if all(a.is_numeric for a in attributes):
        return F.transform(texts, lambda p: F.transform(p, number))
    domains = F.array(*[F.array(*[F.lit(x) for x in a.values]).cast("array<string>") for a in attributes])
    kinds = F.array(*[F.lit("number" if a.is_numeric else a.attr_type) for a in attributes])

    def coded(v: Column, i: Column) -> Column:
        place = F.array_position(F.get(domains, i), _unquoted(v))
        known = F.when(place > 0, (place - 1).cast("double")).otherwise(F.raise_error(F.concat(F.lit("not in its domain: "), v)).cast("double"))
        kind = F.get(kinds, i)
        return F.when((v == "?") | (kind == "string"), F.lit(float("nan"))).when(kind == "nominal", known).otherwise(v.cast("double"))

    return F.transform(texts, lambda p: F.transform(p, coded))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    if encoding.lower().replace("-", "") == "utf8":
        found = spark.read.text(path).select("value", "_metadata.file_name", F.col("_metadata.file_block_start").alias("block"))
        return found.withColumn("row", F.monotonically_increasing_id())
    whole = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name"), F.decode("content", encoding).alias("text"))
    return whole.select(F.posexplode(F.split("text", "\r?\n")).alias("row", "value"), "file_name", F.lit(0).alias("block")).withColumn("row", F.col("row").cast("long"))


def read_arff(spark: SparkSession, path: str, name: str | None = None, bag_column: str = "bag", class_column: str = "class", encoding: str = "utf-8") -> Dataset:
    """Reads one file. A missing file raises FileNotFoundError, a file of another shape ValueError."""
    from pyspark.errors import AnalysisException

    place = F.struct("file_name", "block", "row")
    try:
        lines = _lines(spark, path, encoding)
        begin = lines.where(F.lower(F.trim("value")) == "@data").agg(F.min(place).alias("at")).first().at
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if begin is None:
        raise ValueError(f"no line @data in {path}")
    start = F.struct(F.lit(begin.file_name).alias("file_name"), F.lit(begin.block).cast("long").alias("block"), F.lit(begin.row).cast("long").alias("row"))
    header = [r.value for r in lines.where((place < start) & F.trim("value").startswith("@")).orderBy(place).collect()]
    columns, inner = header_of(header, bag_column, class_column)
    data = lines.where((place > start) & (F.trim("value") != "") & ~F.trim("value").startswith("%"))
    fields = F.regexp_extract_all(F.trim("value"), F.lit(_FIELD), F.lit(1))
    at = lambda k: _unquoted(F.get("fields", k))
    parsed = data.withColumn("fields", fields).select("file_name", "block", "row", at(0).alias("bag_id"), at(columns.index(class_column)).alias("label"), texts_of(at(columns.index(bag_column))).alias("texts"))
    wrong = F.raise_error(F.concat(F.lit(f"a bag has instances that do not have {len(inner)} values: "), F.col("bag_id"))).cast("array<array<string>>")
    checked = parsed.withColumn("texts", F.when(F.exists("texts", lambda p: F.size(p) != len(inner)), wrong).otherwise(F.col("texts")))
    kept = [] if all(a.is_numeric for a in inner) else ["texts"]
    vectors = checked.select("file_name", "block", "row", "bag_id", "label", instances_of(F.col("texts"), inner).alias("instances"), *kept)
    bags = with_rank(vectors, place, "pos").select("pos", "bag_id", "label", "instances", *kept)
    return Dataset(name or re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2]), bags, inner)


class ArffSource:
    """A reader with its options, for many files."""

    def __init__(self, bag_column: str = "bag", class_column: str = "class", encoding: str = "utf-8") -> None:
        self._options = {"bag_column": bag_column, "class_column": class_column, "encoding": encoding}

    bag_column = property(lambda self: self._options["bag_column"])
    class_column = property(lambda self: self._options["class_column"])
    encoding = property(lambda self: self._options["encoding"])

    def load(self, spark: SparkSession, path: str, name: str | None = None) -> Dataset:
        return read_arff(spark, path, name, **self._options)

    def __repr__(self) -> str:
        return f"ArffSource({', '.join(f'{k}={v!r}' for k, v in self._options.items())})"


def files_of(spark: SparkSession, folder: str) -> list[str]:
    """The paths of a folder's ARFF files by name; a missing folder gives none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.arff").load(folder).select("path").collect()
    except AnalysisException:
        return []
    return sorted(r.path for r in found)


def write_arff(data: Dataset, path: str, id_column: str = "bag_id", bag_column: str = "bag", class_column: str = "class", single: bool = False) -> None:
    """Writes a folder of text files that, in order of their names, are one ARFF file: the header, then the bags in order. Ids are
    declared as strings, so nothing but the classes is gathered. single: one file, for bags that one task can write."""
    bags, spark = data.bags, data.bags.sparkSession
    labels = sorted({r.label for r in bags.select("label").distinct().collect() if r.label is not None})
    kind = lambda a: "{" + ",".join(a.values) + "}" if a.attr_type == "nominal" else "numeric" if a.attr_type == "real" else a.attr_type
    quoted = lambda n: f"'{n}'" if re.search(r"\s", n) else n
    head = [f"@relation {data.name}", "", f"@attribute {id_column} string", f"@attribute {bag_column} relational"]
    head += [f"  @attribute {quoted(a.name)} {kind(a)}" for a in data.attributes]
    head += [f"@end {bag_column}", f"@attribute {class_column} {{{','.join(labels)}}}", "", "@data"]
    value = lambda v: F.when(F.isnan(v), "?").otherwise(v.cast("string"))
    if "texts" in bags.columns:
        values = F.transform("texts", lambda p: F.array_join(p, ","))
    else:
        values = F.transform("instances", lambda p: F.array_join(F.transform(p, value), ","))
    own_id = F.when(F.col("bag_id").rlike("""[\\s,%@'"{}]"""), F.concat(F.lit("'"), F.regexp_replace("bag_id", "'", r"\\\\'"), F.lit("'"))).otherwise(F.col("bag_id"))
    rows = bags.select(F.col("pos"), F.concat(own_id, F.lit(',"'), F.array_join(values, "\\n"), F.lit('",'), F.coalesce("label", F.lit("?"))).alias("value"))
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "pos long, value string")
    both = top.union(rows)
    dealt = both.coalesce(1).sortWithinPartitions("pos") if single else both.repartitionByRange("pos").sortWithinPartitions("pos")
    dealt.select("value").write.text(path)
