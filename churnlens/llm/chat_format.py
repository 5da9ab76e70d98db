r"""Chat formatting into budgeted, turn-aligned windows.

1. Places are settled on narrow rows, one for each distinct (conversation, turn,
   role, text), with a digest in place of the text.  Exclusive prefix sums of the
   tokens run over ranges of the order, and only one row for each range carries
   them on, so a conversation that holds a large part of all rows is spread over
   many tasks.  Rows that share a turn number are ranked by role and text first:
   tied and null turns are placed one by one like any others.
2. ``span = prefix // stride`` gives turn-aligned spans.  The stride is what the
   budget leaves after history, system turn and one largest turn, so a window
   keeps to the budget unless a single turn exceeds half of it.
3. A window is: the system turn (retained in every window), the last few turns of
   the span before (limited history), the span's own turns.  Loss covers the own
   assistant texts only; repeated turns are masked.
4. Texts move twice: to their place, and to their windows.  A system turn is
   repeated from one copy for each ``SALT`` windows.

Template: ``<|im_start|>role\ntext<|im_end|>\n``.  Texts are escaped reversibly: a
backslash is doubled, and one backslash goes after the first character of a
control string, so that no control string stands inside a text.

Null text or role is empty.  Turns are ordered by (turn, role, text), nulls
first; repeated rows are turns of their own.  Rows with a null conv_id form one conversation.  An empty
table gives no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import rank_within_groups, totals_before
from ..session import cut_lineage

# fixed values: the template and the control strings of common templates
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"
RUN, BLANK = "[0-9A-Za-z]+", r"[\x00-\x20]+"
TURN_TOKENS = 4  # the markers of a turn

BUDGET, HISTORY_TOKENS, HISTORY_TURNS, SALT = 1024, 192, 2, 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the first line end, so its own line ends are written as ``<\\n>``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character that is not blank, plus the markers."""
    return F.length(F.regexp_replace(F.regexp_replace(text, RUN, "a"), BLANK, "")).cast("long") + TURN_TOKENS


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.md5("text"))


_KEY = ["conv_id", "turn", "role", "mark"]


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal; the key columns appear once."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def _tie_ranks(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``units`` with ``tie``: the place by (role, text) among the distinct rows of a turn number."""
    tied = cut_lineage(units.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    if not tied.limit(1).count():
        return units.withColumn("tie", F.lit(1).cast("long"))
    texts = _on(rows, tied, ["conv_id", "turn"]).groupBy(*_KEY).agg(F.first("text").alias("text"))
    ranked = rank_within_groups(texts.withColumn("at", F.struct("conv_id", "turn")), "at", [F.col("role"), F.col("text")], "tie").select(*_KEY, "tie")
    return _on(units, ranked, _KEY, "left").withColumn("tie", F.coalesce("tie", F.lit(1)))


def turn_places(rows: DataFrame, budget: int, history_tokens: int, history_turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without texts: (conv_id, turn, role, mark, idx, window, kind) of every own (kind 2) and history (kind 1) turn;
    (conv_id, turn, mark) of the system turns; (conv_id, span) of the windows."""
    units = cut_lineage(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max(turn_tokens(F.col("text"))).alias("tokens")))
    units = _tie_ranks(rows, units).withColumn("all", F.col("n") * F.col("tokens"))
    convs = units.groupBy("conv_id").agg(F.max("tokens").alias("most"), F.min(F.struct("turn", "tie", "role", "tokens")).alias("head"))
    system = F.col("head.role") == "system"
    room = budget - history_tokens - F.when(system, F.col("head.tokens")).otherwise(0) - F.least("most", F.lit(budget // 2))
    convs = convs.select("conv_id", system.alias("system"), F.greatest(room, F.lit(budget // 4)).alias("stride"))
    placed = totals_before(units, ["conv_id"], [F.col("turn"), F.col("tie")], ["n", "all"])
    copy = _on(placed, convs, ["conv_id"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    before = F.col("all_before") + F.col("copy") * F.col("tokens")
    turns = cut_lineage(copy.select(*_KEY, "system", (F.col("n_before") + F.col("copy")).alias("idx"), before.alias("before"),
                                    F.floor(before / F.col("stride")).alias("span")))
    spans = cut_lineage(turns.groupBy("conv_id", "span").agg(F.min("before").alias("start"), F.min("idx").alias("first")))
    own = turns.select(*_KEY, "idx", F.col("span").alias("window"), F.lit(2).alias("kind"))
    head = F.col("system") & (F.col("idx") == 0)
    if history_turns > 0:
        # a window asks for the turns just before its first one; those of the last span before it are its history
        asked = spans.where("first > 0").select("conv_id", F.col("span").alias("window"), "start",
                                                F.explode(F.sequence(F.col("first") - history_turns, F.col("first") - 1)).alias("idx"))
        near = _on(turns, asked, ["conv_id", "idx"])
        last = F.max("span").over(Window.partitionBy("conv_id", "window"))  # at most ``history_turns`` rows
        near = near.withColumn("last", last).where((F.col("span") == F.col("last")) & (F.col("start") - F.col("before") <= history_tokens) & ~head)
        own = own.unionByName(near.select(*_KEY, "idx", "window", F.lit(1).alias("kind")))
    return own, turns.where(head).select("conv_id", "turn", "mark", "span"), spans.select("conv_id", "span")


def _system_rows(rows: DataFrame, heads: DataFrame, spans: DataFrame) -> DataFrame:
    """The system turn of a conversation for each of its windows but the one it begins in."""
    text = rows.where("role = 'system'").groupBy(*_KEY).agg(F.first("text").alias("text"))
    heads = _on(_on(heads, text, ["conv_id", "turn", "mark"]), spans.groupBy("conv_id").agg(F.max("span").alias("end")), ["conv_id"])
    copies = heads.select("conv_id", "text", F.col("span").alias("home"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / SALT))).alias("salt"))
    windows = spans.withColumn("salt", F.floor(F.col("span") / SALT))
    return _on(windows, copies, ["conv_id", "salt"]).where("span <> home").select(
        "conv_id", F.lit("system").alias("role"), "text", F.lit(0).cast("long").alias("idx"), F.col("span").alias("window"), F.lit(0).alias("kind"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                   history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, window, n_repeated (leading repeated turns), text, loss (array of start, end in code points), tokens."""
    rows = _rows(conversations)
    places, heads, spans = turn_places(rows, budget, history_tokens, history_turns)
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    rows = _on(texts, places, _KEY).select("conv_id", "role", "text", "idx", "window", "kind").unionByName(_system_rows(rows, heads, spans))
    whole = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("kind", "idx", "role", "text"))).alias("turns"),
        F.sum(turn_tokens(F.col("text"))).alias("tokens"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    whole = whole.withColumn("parts", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"),
        ((t["kind"] == 2) & (t["role"] == "assistant")).alias("loss"))))
    part_chars = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END) + 1
    # a turn has four tokens at least, so the budget bounds the parts of a window, and summing those before each is cheap
    placed = F.transform("parts", lambda p, i: F.struct(
        p["loss"].alias("loss"),
        (F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + part_chars(q)) + F.length(p["head"])).alias("start"),
        F.length(p["body"]).alias("chars")))
    loss = F.transform(F.filter(placed, lambda s: s["loss"]),
                       lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["chars"]).alias("end")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return whole.select("conv_id", "window", F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
                        text.alias("text"), loss.alias("loss"), "tokens")


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse windows: conv_id, window, turns (role, text of the window's own turns), targets (texts under the loss), chars."""
    pieces = F.split("text", r"<\|im_end\|>\n", -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    bare = F.transform(own, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(bare, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"),
                          F.length("text").cast("long").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone.

    A digest of a whole conversation needs its whole text in one value, so the
    windows of a conversation meet here; the operator above never does that.
    """
    read = read_windows(windows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = read.select("conv_id", "window", told.alias("told"), F.size("turns").cast("long").alias("n"),
                       F.array_join("targets", "").alias("target"), "chars")
    conv = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                       F.array_sort(F.collect_list(F.struct("window", "told", "target"))).alias("parts"))
    told, target = F.array_join(F.col("parts.told"), ""), F.array_join(F.col("parts.target"), "")
    return conv.select("conv_id", "n_turns", F.sha2(told, 256).alias("turns_sha256"),
                       F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"),
                       "formatted_chars")
