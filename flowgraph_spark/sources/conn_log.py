"""Connection logs: tab-separated text with a ``#fields`` header."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import PLACE_BITS
from ..schema import FIELD_RENAMES, LABEL_COLUMNS
from ..session import cut_lineage

LABEL_COLUMN_NAMES = ("label", "detailed_label")
# Different header names over all logs of one scan; beyond this the input is no connection log.
MAX_FIELDS = 1000


def header_fields(lines: DataFrame, column="value"):
    """Field names of the first ``#fields`` line, one small job per log."""
    found = lines.where(F.col(column).startswith("#fields")).select(column).limit(1).collect()
    if not found:
        raise ValueError("The log has no #fields header.")
    names = [n for n in found[0][0].rstrip("\r\n").split("\t")[1:]]
    return [FIELD_RENAMES.get(n, n) for n in names]


def _tokens(lines, column):
    """Data lines cut into tab fields; comments and blank lines are left out."""
    text = F.col(column)
    data = lines.where((~text.startswith("#")) & (F.trim(text) != ""))
    return data.withColumn("__tokens", F.split(F.rtrim(text, F.lit("\r\n")), "\t", -1))


def parse_conn_log(lines: DataFrame, fields=None, column="value", carry=()) -> DataFrame:
    """Rows of a log as text columns; lines with too many fields are skipped.

    Short lines are padded with null. ``carry`` names columns kept beside the
    parsed fields. The combined label column is split when needed.
    """
    names = fields or header_fields(lines, column)
    width = len(names)
    rows = _tokens(lines, column).where(F.size("__tokens") <= width)
    parsed = rows.select(
        *carry,
        *[F.try_element_at("__tokens", F.lit(i + 1)).alias(name) for i, name in enumerate(names)],
    )
    return split_label_column(parsed)


def count_bad_lines(lines: DataFrame, fields=None, column="value", by=()) -> DataFrame:
    """Parsed and skipped line counts, per ``by`` group."""
    width = len(fields or header_fields(lines, column))
    flagged = _tokens(lines, column)
    return flagged.groupBy(*by).agg(
        F.count_if(F.size("__tokens") <= width).alias("parsed_rows"),
        F.count_if(F.size("__tokens") > width).alias("parse_error_rows"),
    )


def bad_lines(lines: DataFrame, fields=None, column="value") -> DataFrame:
    """Quarantine: the lines ``parse_conn_log`` skips."""
    width = len(fields or header_fields(lines, column))
    return _tokens(lines, column).where(F.size("__tokens") > width).drop("__tokens")


def split_label_column(df: DataFrame) -> DataFrame:
    """Split the last column on blanks into tunnel parents, label and detail.

    A log may write the three label values into one tab field. If the label
    columns already exist this changes nothing.
    """
    if all(c in df.columns for c in LABEL_COLUMN_NAMES):
        return df
    last = df.columns[-1]
    parts = F.split(F.trim(F.col(f"`{last}`")), r"\s+", 3)
    kept = [F.col(f"`{c}`") for c in df.columns[:-1] if c not in LABEL_COLUMNS]
    return df.select(
        *kept,
        *[F.try_element_at(parts, F.lit(i + 1)).alias(name) for i, name in enumerate(LABEL_COLUMNS)],
    )


def file_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files with the file they come from and ``__at``, their order in it."""
    # Ids rise within a task, and a block is read by one task.
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), at.alias("__at"))


def _header_names():
    """Field names of a ``#fields`` line; null on other lines."""
    names = F.slice(F.split(F.rtrim("value", F.lit("\r\n")), "\t", -1), 2, 1 << 20)
    renamed = F.transform(
        names, lambda n: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in FIELD_RENAMES.items() for x in p]), n), n)
    )
    return F.when(F.col("value").startswith("#fields"), renamed)


def block_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per file and input block: ``__before``, the field names in force where it
    begins (the file's first ones in front of any header), and ``__turns``, whether a
    header in it gives others. ``headers`` are the header lines with ``__block`` and ``__names``."""
    keys = ["__file", "__block"]
    own = headers.groupBy(*keys).agg(
        F.min_by("__names", "__at").alias("__first"), F.max_by("__names", "__at").alias("__last"),
        F.min("__names").alias("__least"), F.max("__names").alias("__most"),
    )
    blocks = lines.select("__file", F.col("__at.block").alias("__block")).distinct().join(own, keys, "left")
    along = Window.partitionBy("__file").orderBy("__block")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.last("__last", True).over(past), F.first("__first", True).over(whole))
    turns = (F.col("__least") != F.col("__before")) | (F.col("__most") != F.col("__before"))
    return blocks.withColumn("__before", before).select(*keys, "__before", F.coalesce(turns, F.lit(False)).alias("__turns"))


def _read_by_headers(lines, headers, layout):
    """Data lines as ``__tokens`` with ``__layout``, that of the names in the header before each.

    Lines of a block whose fields do not change take those it begins with and stay where
    they are. The lines of other blocks are sorted by block, which one task reads in any
    case, and take the newest header: a log may change its fields any number of times.
    """
    keys = ["__file", "__block"]
    blocks = block_headers(lines, headers)
    blocks = cut_lineage(blocks.withColumn("__before", layout(F.col("__before"))))
    placed = lines.withColumn("__block", F.col("__at.block"))
    steady = _tokens(placed, "value").join(blocks, keys, "left").where(~F.coalesce("__turns", F.lit(False)))
    so_far = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turning = placed.join(blocks.where("__turns"), keys).withColumn("__own", layout(_header_names()))
    newest = F.coalesce(F.last("__own", True).over(so_far), F.col("__before"))
    turning = _tokens(turning.withColumn("__layout", newest).drop("__own"), "value")
    return steady.withColumn("__layout", F.col("__before")).unionByName(turning).drop("__before", "__turns", "__block")


def parse_files(lines: DataFrame, carry=(), max_fields=MAX_FIELDS) -> DataFrame:
    """Rows of many log files, each read by the header before it in its own file.

    ``lines`` has ``value``, ``__file`` and ``__at`` as of :func:`file_lines`. Rows in
    front of a file's first header are read by that one. The columns are the union of
    all header names, sorted by their first place; a field that a header lacks is
    null. Lines with more fields than their header are skipped, shorter ones
    padded. A file with data but no header is an error, and so are more than
    ``max_fields`` different names. A last field that holds three labels is split
    under each header that has no label columns of its own.
    """
    headers = cut_lineage(
        lines.select("__file", "__at", F.col("__at.block").alias("__block"), _header_names().alias("__names"))
        .where(F.col("__names").isNotNull())
    )
    own = F.array_contains("__names", LABEL_COLUMN_NAMES[0]) & F.array_contains("__names", LABEL_COLUMN_NAMES[1])
    # One row per name over all files: as many as a log has fields, not as there are logs.
    named = headers.select("__names").distinct().select(own.alias("own"), F.size("__names").alias("n"), F.posexplode("__names").alias("place", "name"))
    holds_labels = ~F.col("own") & (F.col("place") == F.col("n") - 1)
    found = (
        named.groupBy("name").agg(F.min("place").alias("place"), F.max(holds_labels).alias("labels"))
        .orderBy("place", "name").limit(max_fields + 1).collect()
    )
    if not found:
        raise ValueError("The logs have no #fields header.")
    if len(found) > max_fields:
        raise ValueError(f"The logs have more than {max_fields} different fields.")
    plain = [row["name"] for row in found if not row["labels"] and row["name"] not in LABEL_COLUMNS]
    wanted = [*plain, *LABEL_COLUMNS]

    def layout(names):
        # Places are looked up per header, not per row.
        places = F.transform(F.array(*[F.lit(n) for n in wanted]), lambda n: F.array_position(names, n).cast("int"))
        labelled = F.array_contains(names, LABEL_COLUMN_NAMES[0]) & F.array_contains(names, LABEL_COLUMN_NAMES[1])
        return F.when(names.isNotNull(), F.struct(places.alias("places"), F.size(names).alias("width"), labelled.alias("own")))

    rows = _read_by_headers(lines, headers, layout)
    width = F.col("__layout.width")
    known = F.when(
        F.col("__layout").isNull(), F.raise_error(F.concat(F.lit("no #fields header in "), F.col("__file")))
    ).otherwise(F.size("__tokens") <= width)
    # One small expression for all fields: generated code stays below what the JIT compiles.
    values = F.transform("__layout.places", lambda p: F.when(p > 0, F.try_element_at("__tokens", p)))
    last = F.split(F.trim(F.try_element_at("__tokens", width)), r"\s+", 3)
    rows = rows.where(known).select(*carry, values.alias("__values"), last.alias("__last"), F.col("__layout.own").alias("__own"))
    fields = [F.col("__values")[i] for i in range(len(wanted))]
    labels = [
        F.when(F.col("__own"), fields[len(plain) + i]).otherwise(F.try_element_at("__last", F.lit(i + 1))).alias(name)
        for i, name in enumerate(LABEL_COLUMNS)
    ]
    return rows.select(*carry, *[f.alias(n) for f, n in zip(fields, plain)], *labels)


def read_conn_log(spark: SparkSession, path) -> DataFrame:
    """All data rows of one or many log files as text columns.

    Each row is read by the header before it in its file, so rotated and concatenated
    logs may change their fields. Text is decoded as UTF-8; undecodable bytes become the replacement character.
    """
    return parse_files(file_lines(spark, path))


def scan_scenarios(spark: SparkSession, paths) -> DataFrame:
    """Several logs in one scan, each row tagged with its scenario.

    ``paths`` maps a scenario to a file or folder. Every file is read by its
    own header and merged by column name, so neither the order of scenarios nor
    that of fields matters. A file belongs to the scenario of the longest path
    that begins its own, and to all scenarios that share this path.
    """
    lines = file_lines(spark, sorted(set(paths.values())))
    tagged = []
    for name, path in paths.items():
        # The file's name may have another scheme or authority in front.
        bare = path.rstrip("/").split(":", 1)[-1].lstrip("/")
        of = F.contains(F.col("__file"), F.lit(f"/{bare}/")) | F.endswith(F.col("__file"), F.lit(f"/{bare}"))
        tagged.append(F.when(of, F.struct(F.lit(len(bare)).alias("size"), F.lit(name).alias("scenario"))))
    found = F.array_compact(F.array(*tagged))
    longest = F.array_max(F.transform("__found", lambda t: t["size"]))
    own = F.filter("__found", lambda t: t["size"] == longest)
    placed = lines.withColumn("__found", found).select("value", "__file", "__at", F.inline(own))
    return parse_files(placed, ["scenario"])


#: Input blocks whose offsets are broadcast: about 100 bytes each.
BROADCAST_BLOCKS = 1_000_000


def with_file_position(lines: DataFrame, position="position", broadcast_blocks=BROADCAST_BLOCKS) -> DataFrame:
    """0-based row number in file order for rows read straight from files.

    Positions come from per-block row counts: an input block is one row of a table
    that goes to the tasks, so no line moves and no single task sorts. There are at
    most the input's bytes over ``spark.sql.files.maxPartitionBytes`` blocks and one per
    file; beyond ``broadcast_blocks`` they are joined as Spark decides. ``lines`` must be
    a file scan with at most filters on top. A block that the second scan gives to
    another task than the first is an error, never a wrong number.
    """
    tagged = lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = tagged.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    earlier = (
        Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cut_lineage(
        blocks.select(
            F.col("__file").alias("__f"), F.col("__block").alias("__b"), "__first",
            F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        )
    )
    side = F.broadcast(offsets) if offsets.count() <= broadcast_blocks else offsets
    joined = tagged.join(side, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")), "left")
    # The upper bits of an id are the task's number.
    same_task = F.shiftright("__first", PLACE_BITS) == F.shiftright("__id", PLACE_BITS)
    number = F.when(same_task, F.col("__before") + F.col("__id") - F.col("__first")).otherwise(
        F.raise_error(F.concat(F.lit("the blocks changed between two scans of "), F.col("__file")))
    )
    return joined.withColumn(position, number).drop("__file", "__block", "__id", "__f", "__b", "__first", "__before")


# Fixed value: namespace of stable row identities.
ROW_ID_PREFIX = "phase1-clean-v1"


def with_stable_row_id(df: DataFrame, scenario, position, row_id="row_id") -> DataFrame:
    """SHA-256 identity from the scenario and the position in its log."""
    return df.withColumn(
        row_id,
        F.sha2(
            F.concat_ws(":", F.lit(ROW_ID_PREFIX), F.col(scenario), F.col(position).cast("string")),
            256,
        ),
    )
