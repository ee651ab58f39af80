"""Labelled variants of clean rasters: capacity, keyed order, block codes, round trip.

A corpus job multiplies every clean image by the variant dimension. Each image is one
row, and coding changes pixels of that row only, so the whole expansion is a map-side
pipeline: no pixel is shuffled, and a source that holds most of the images is spread like
any other rows. Two producers give the same pixels: ``native`` array expressions, and
``arrow`` kernels (``coding``), which are far faster on large images.

Layout of a coded image (code parameter p, blocks of n = 2^p - 1 pixels): the first
``max(2, ceil(128 / p)) * n`` pixels are the head and carry 16 bytes of the cover's
SHA-256; all later pixels are the body and carry the message. Pixels are taken in the
order of keys cut from MD5 digests seeded by password and, for the body, by the cover hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscope.functions.columns import utf8_bytes
from grainscope.operators import coding
from grainscope.schemas import PHOTO
from grainscope.sources.rasters import content_hash, pixel_column

HEAD_BITS = 128
LENGTH_BITS = 16
MESSAGE_LETTER = "S"


def let(body: str, **values: str) -> str:
    """SQL: body with names bound to values that are evaluated once.

    A column used inside a lambda may be replaced by its whole defining expression when
    projections are merged, and would then be evaluated for every element.
    """
    for name, value in values.items():
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


# ---------------------------------------------------------------- sizes
def capacity_bytes(pixels: str, p: str) -> str:
    """SQL: whole bytes a block code of parameter p carries in so many pixels, at least one."""
    return (f"greatest(1L, (case when {p} >= 1 then {pixels} * {p} div (shiftleft(1, {p}) - 1) "
            f"else {pixels} div 8 end) div 8)")


def payload_bytes(pixels: str, method: str, p: str, density: str) -> str:
    """SQL: message length of a variant, a share of the capacity, or of the pixels for plain LSB."""
    return (f"cast(case when {method} = 'lsb' then floor({pixels} * {density} / 8) "
            f"else floor({capacity_bytes(pixels, p)} * {density}) end as int)")


def expand(covers: DataFrame, variants: DataFrame, message: Column | None = None) -> DataFrame:
    """Every cover times every variant, with sizes and a status.

    ``variants`` is a dimension of a dozen rows. Covers that cannot hold head and message
    keep a row with the reason in ``status`` instead of vanishing. Only the number of pixels is read: covers may have
    ``content`` in place of ``px``.
    """
    v = variants.withColumnRenamed("variant", "to_variant")
    sized = (covers.crossJoin(F.broadcast(v)).withColumn("n_px", pixel_column(covers)[1])
             .withColumn("code_n", F.expr("shiftleft(1, p) - 1")))
    if message is None:
        sized = (sized.withColumn("msg_bytes", F.expr(payload_bytes("n_px", "method", "p", "density")))
                 .withColumn("message", F.expr(f"repeat('{MESSAGE_LETTER}', msg_bytes)")))
    else:
        sized = sized.withColumn("message", message).withColumn("msg_bytes", F.octet_length("message"))
    lsb = F.col("method") == "lsb"
    head = F.expr(f"cast(greatest(2, ({HEAD_BITS} + p - 1) div greatest(p, 1)) * code_n as int)")
    need = F.expr(f"cast(({LENGTH_BITS} + 8 * msg_bytes + p - 1) div greatest(p, 1) as int)")
    return (sized.withColumn("head_px", F.when(lsb, 0).otherwise(head))
            .withColumn("body_blocks", F.when(lsb, 0).otherwise(need))
            .withColumn("status", F.when(F.col("msg_bytes") > 65535, "message too long")
                        .when(lsb & (F.col("n_px") <= LENGTH_BITS + 8), "image too small")
                        .when(~lsb & (F.col("n_px") <= F.col("head_px") + F.col("code_n")), "image too small")
                        .when(~lsb & F.expr("body_blocks * code_n > n_px - head_px"), "message too long")
                        .otherwise("ok")))


# ---------------------------------------------------------------- bits
def bits_of(value: Column, places: range) -> Column:
    """Array of the value's bits at the given places."""
    return F.array(*[F.shiftright(value, i).bitwiseAND(F.lit(1)) for i in places])


def message_bits(message: Column, length_lsb_first: bool = True) -> Column:
    """16 length bits, then the UTF-8 bytes most significant bit first.

    The block codes store the length least significant bit first, plain LSB stores it most
    significant bit first.
    """
    places = range(LENGTH_BITS) if length_lsb_first else range(LENGTH_BITS - 1, -1, -1)
    body = F.flatten(F.transform(utf8_bytes(message), lambda b: bits_of(b, range(7, -1, -1))))
    return F.concat(bits_of(F.octet_length(message), places), body)


def text_of_bits(bits: str) -> Column:
    """Inverse of the block-code form: the length, then that many bytes as UTF-8."""
    length = f"aggregate(sequence(0, {LENGTH_BITS - 1}), 0, (a, i) -> a + shiftleft(bits[i], i))"
    whole = f"least({length}, (size(bits) - {LENGTH_BITS}) div 8)"
    octet = f"aggregate(sequence(0, 7), 0, (a, i) -> 2 * a + bits[{LENGTH_BITS} + 8 * b + i])"
    return F.expr(let(let(
        "if(octets < 1, '', cast(unhex(array_join(transform(sequence(0, greatest(octets, 1) - 1), "
        f"b -> lpad(hex({octet}), 2, '0')), '')) as string))", octets=whole), bits=bits))


# ---------------------------------------------------------------- order
def keyed_cells(px: str, seed: str) -> Column:
    """Cells (i, v) of a pixel array in keyed order: the key of pixel i is the quarter
    i mod 4 of md5(seed:(i div 4)), ties in pixel order."""
    return F.expr(let(
        f"transform(sort_array(transform({px}, (v, i) -> named_struct("
        "'h', substr(md5(concat(seed, ':', i div 4)), 8 * (i % 4) + 1, 8), 'i', i, 'v', cast(v as int)))), "
        "c -> named_struct('i', c.i, 'v', c.v))", seed=seed))


def without_head(cells: str) -> Column:
    return F.expr(let(f"filter({cells}, c -> c.i >= head)", head="head_px"))


def with_cover_order(covers: DataFrame, password: str = "") -> DataFrame:
    """Add the cover hash and the keyed order of all pixels, once per image.

    The body pool of any code parameter is this order without the head's pixels, so the
    sort is shared by all variants of the image.
    """
    return (covers.withColumn("cover_sha256", content_hash())
            .withColumn("body_seed", F.concat(F.substring("cover_sha256", 1, HEAD_BITS // 4), F.lit(password)))
            .withColumn("ordered", keyed_cells("px", "body_seed")))


def block_array(pool: str, count: str, bits: str) -> Column:
    """Blocks of n cells of a pool, cells in image order, with the p message bits to carry."""
    chunk = "aggregate(sequence(0, p - 1), 0, (a, r) -> a + shiftleft(coalesce(get(bits, b * p + r), 0), r))"
    return F.expr(let(f"transform(sequence(0, {count} - 1), b -> named_struct('m', {chunk}, "
                      "'cells', sort_array(slice(pool, b * n + 1, n))))",
                      bits=bits, pool=pool, n="code_n"))


# XOR of the 1-based numbers of the odd cells in a block
_SYNDROME = ("aggregate(transform({cells}, (c, j) -> if(c.v % 2 = 1, j + 1, 0)), 0, (a, j) -> a ^ j)")


def with_targets(df: DataFrame, blocks: str) -> DataFrame:
    """Add ``d`` to each block: the column whose flip makes the syndrome equal the message,
    and ``dry``, the columns more than 1 away from the middle gray."""
    dry = "filter(transform(blk.cells, (c, j) -> if(abs(c.v - 128) > 1, j + 1, 0)), j -> j > 0)"
    return df.withColumn(blocks, F.expr(
        f"transform({blocks}, blk -> named_struct('cells', blk.cells, "
        f"'d', ({_SYNDROME.format(cells='blk.cells')}) ^ blk.m, 'dry', {dry}))"))


def with_picks(df: DataFrame, blocks: str) -> DataFrame:
    """Add ``pick``, the columns to move one step, for the wet-paper code.

    Order of choice: the target column if dry; the smallest pair of dry columns whose
    numbers XOR to the target; else the combination with the smallest bit mask, found by
    extending the reachable sums one dry column at a time. NULL when the dry columns do not
    span the target.
    """
    first = "get(filter(blk.dry, a -> a < (a ^ blk.d) and array_contains(blk.dry, a ^ blk.d)), 0)"
    paired = df.withColumn(blocks, F.expr(
        f"transform({blocks}, blk -> named_struct('cells', blk.cells, 'd', blk.d, 'dry', blk.dry, "
        f"'a', if(array_contains(blk.dry, blk.d), null, {first})))"))
    reach = ("aggregate(blk.dry, "
             "transform(sequence(0, size(blk.cells)), s -> if(s = 0, cast(array() as array<int>), null)), "
             "(seen, c) -> transform(seen, (e, s) -> coalesce(e, concat(seen[s ^ c], array(c)))))")
    return paired.withColumn(blocks, F.expr(
        f"transform({blocks}, blk -> named_struct('cells', blk.cells, 'd', blk.d, 'pick', "
        "case when blk.d = 0 then cast(array() as array<int>) "
        "when array_contains(blk.dry, blk.d) then array(blk.d) "
        f"when blk.a is not null then array(blk.a, blk.a ^ blk.d) else {reach}[blk.d] end))"))


def with_new_cells(df: DataFrame, blocks: str) -> DataFrame:
    """Apply the change of each block: flip the target's low bit, or step the picked cells
    towards the middle gray. An unsolvable wet-paper block falls back to the flip."""
    flip = "if(j + 1 = blk.d, c.v ^ 1, c.v)"
    step = "if(array_contains(blk.pick, j + 1), c.v - cast(signum(c.v - 128) as int), c.v)"
    return df.withColumn(blocks, F.expr(
        f"flatten(transform({blocks}, blk -> transform(blk.cells, (c, j) -> named_struct('i', c.i, "
        f"'v', if(method = 'matrix' or blk.pick is null, {flip}, {step})))))"))


def code_blocks(pairs: DataFrame, password: str = "") -> DataFrame:
    """Coded pixels ``coded`` for matrix and wet-paper variants (rows with status ok)."""
    hash_bytes = F.expr(f"transform(regexp_extract_all(substr(cover_sha256, 1, {HEAD_BITS // 4}), '(..)', 1), "
                        "h -> cast(conv(h, 16, 10) as int))")
    staged = (pairs.withColumn("head_pool", keyed_cells("slice(px, 1, head_px)", f"'head{password}'"))
              .withColumn("body_pool", without_head("ordered"))
              .withColumn("head_bits", F.flatten(F.transform(hash_bytes, lambda b: bits_of(b, range(7, -1, -1)))))
              .withColumn("body_bits", message_bits(F.col("message"))))
    blocked = staged.withColumn("blocks", F.concat(
        block_array("head_pool", "head_px div code_n", "head_bits"),
        block_array("body_pool", "body_blocks", "body_bits")))
    solved = with_new_cells(with_picks(with_targets(blocked, "blocks"), "blocks"), "blocks")
    rest = "slice(body_pool, body_blocks * code_n + 1, size(body_pool))"
    return solved.withColumn("coded", F.expr(
        f"transform(sort_array(concat(blocks, {rest})), c -> cast(c.v as smallint))")).drop(
        "head_pool", "body_pool", "head_bits", "body_bits", "blocks")


def code_lsb(pairs: DataFrame) -> DataFrame:
    """Coded pixels for plain LSB replacement: bit k goes to pixel k."""
    bits = message_bits(F.col("message"), length_lsb_first=False)
    return pairs.withColumn("_bits", bits).withColumn("coded", F.expr(let(
        "transform(px, (v, i) -> cast(coalesce(v - v % 2 + get(bits, i), v) as smallint))",
        bits="_bits"))).drop("_bits")


def coding_job(name: str, method: str, p: str, density: str, message: str | None = None) -> str:
    """SQL: the struct of one coding job of the cover ``px``, from SQL values; sizes and status are those of ``expand``."""
    lsb, code_n = f"{method} = 'lsb'", f"(shiftleft(1, {p}) - 1)"
    text = message or f"repeat('{MESSAGE_LETTER}', {payload_bytes('size(px)', method, p, density)})"
    head = f"cast(if({lsb}, 0, greatest(2, ({HEAD_BITS} + {p} - 1) div greatest({p}, 1)) * {code_n}) as int)"
    need = f"cast(if({lsb}, 0, ({LENGTH_BITS} + 8 * bytes + {p} - 1) div greatest({p}, 1)) as int)"
    status = (f"case when bytes > 65535 then 'message too long' when {lsb} and n <= {LENGTH_BITS + 8} then 'image too small' "
              f"when not {lsb} and n <= head + {code_n} then 'image too small' "
              f"when not {lsb} and need * {code_n} > n - head then 'message too long' else 'ok' end")
    fields = (f"named_struct('to_variant', {name}, 'method', {method}, 'p', cast({p} as int), 'density', cast({density} as double), "
              f"'n_px', n, 'code_n', {code_n}, 'msg_bytes', bytes, 'message', text, 'head_px', head, 'body_blocks', need, 'status', {status})")
    return let(let(let(let(let(fields, need=need), head=head), bytes="octet_length(text)"), text=text), n="size(px)")


def coded_pairs(covers: DataFrame, variants: DataFrame, password: str = "",
                message: Column | None = None, producer: str = "arrow") -> DataFrame:
    """Cover and coded pixels side by side, one row per cover and variant that fits.

    ``variants`` is a dimension of a dozen rows; it becomes an array of jobs, so that a cover is coded in one call.
    """
    if producer == "arrow":
        def text(v: str) -> str:
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

        held = covers if message is None else covers.withColumn("_message", message)
        jobs = ", ".join(coding_job(text(v["variant"]), text(v["method"]), str(v["p"]), f"{v['density']!r}D", None if message is None else "_message")
                         for v in variants.collect())
        fitting = F.filter(F.expr(f"array({jobs})").cast(T.ArrayType(coding.JOB)), lambda j: j["status"] == "ok")
        return coding.code_covers(held.withColumn("jobs", fitting).drop("_message"), password)
    pairs = expand(with_cover_order(covers, password), variants, message)
    good = pairs.where(F.col("status") == "ok")
    lsb = code_lsb(good.where(F.col("method") == "lsb"))
    return code_blocks(good.where(F.col("method") != "lsb"), password).unionByName(lsb)


#: States of a coded image whose fingerprint and readability are compared.
TAMPERED = "transform(coded, (v, i) -> cast(if(i % 97 = 0, v ^ 1, v) as smallint))"


def tamper_states(pairs: DataFrame) -> DataFrame:
    """Each coded pair as three rows (``state``, ``seen``): the clean, the coded, and a tampered image (the low bit of every
    97th pixel turned). One coding pass serves all three."""
    return pairs.select("*", F.inline(F.array(*[
        F.struct(F.lit(state).alias("state"), F.expr(px).alias("seen")) for state, px in (("clean", "px"), ("stego", "coded"), ("tampered", TAMPERED))])))


def rejected_pairs(covers: DataFrame, variants: DataFrame) -> DataFrame:
    """Covers that could not be coded, with the reason."""
    return (expand(covers, variants).where(F.col("status") != "ok")
            .select(*PHOTO, F.col("to_variant").alias("variant"), "method", "p", "density", "status"))


def changed_pixels() -> Column:
    return F.aggregate(F.zip_with("px", "coded", lambda a, b: F.when(a != b, 1).otherwise(0)),
                       F.lit(0), lambda acc, x: acc + x)


def labelled_corpus(covers: DataFrame, variants: DataFrame, password: str = "") -> DataFrame:
    """Clean rows (label 0, no method) and coded rows (label 1) in one raster table."""
    coded = coded_pairs(covers, variants, password).withColumn(
        "changed_frac", F.round(changed_pixels() / F.col("n_px"), 4))
    stego = coded.select(*PHOTO, F.col("to_variant").alias("variant"), "method", "p", "density",
                         F.lit(1).alias("label"), "height", "width", F.col("coded").alias("px"), "changed_frac")
    clean = covers.select(
        *PHOTO, F.lit("clean").alias("variant"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("int").alias("p"), F.lit(None).cast("double").alias("density"),
        F.lit(0).alias("label"), "height", "width", "px", F.lit(None).cast("double").alias("changed_frac"))
    return clean.unionByName(stego)


# ---------------------------------------------------------------- round trip
def read_bits(pool: str, count: str) -> Column:
    """Message bits in the blocks of a pool."""
    syndrome = _SYNDROME.format(cells="cells")
    return F.expr(let(
        f"flatten(transform(transform(transform(sequence(0, {count} - 1), "
        f"b -> sort_array(slice(pool, b * n + 1, n))), cells -> {syndrome}), "
        "s -> transform(sequence(0, p - 1), r -> shiftright(s, r) & 1)))", pool=pool, n="code_n"))


def extract_text(coded: DataFrame, password: str = "", px: str = "coded",
                 producer: str = "arrow") -> DataFrame:
    """Read the message of a block code back from its pixels alone.

    The head gives the cover hash (``found_hash``), the hash gives the body order, the first
    16 body bits give the length of ``found_text``.
    """
    if producer == "arrow":
        return coding.with_found(coded, password, px)
    nibble = "8 * bits[4 * k] + 4 * bits[4 * k + 1] + 2 * bits[4 * k + 2] + bits[4 * k + 3]"
    head = (coded.withColumn("_pool", keyed_cells(f"slice({px}, 1, head_px)", f"'head{password}'"))
            .withColumn("_head", read_bits("_pool", "head_px div code_n"))
            .withColumn("found_hash", F.expr(let(
                f"lower(array_join(transform(sequence(0, {HEAD_BITS // 4 - 1}), k -> hex({nibble})), ''))",
                bits="_head"))))
    body = (head.withColumn("_seed", F.concat("found_hash", F.lit(password)))
            .withColumn("_all", keyed_cells(px, "_seed"))
            .withColumn("_pool", without_head("_all"))
            .withColumn("_bits", read_bits("_pool", "size(_pool) div code_n")))
    return body.withColumn("found_text", text_of_bits("_bits")).drop(
        "_pool", "_head", "_seed", "_all", "_bits")


def extract_lsb_text(coded: DataFrame, px: str = "coded") -> DataFrame:
    """Read a plain LSB message back: 16 length bits, then bytes, most significant bit first."""
    low = coded.withColumn("_low", F.expr(f"transform({px}, v -> cast(v % 2 as int))"))
    turned = low.withColumn("_bits", F.expr(
        f"concat(reverse(slice(_low, 1, {LENGTH_BITS})), slice(_low, {LENGTH_BITS + 1}, size(_low)))"))
    return turned.withColumn("found_text", text_of_bits("_bits")).drop("_low", "_bits")


def round_trip(pairs: DataFrame, password: str = "", producer: str = "arrow") -> DataFrame:
    """Per variant of each image: was the message, and the cover hash, read back exactly?"""
    lsb = F.col("method") == "lsb"
    blocks = extract_text(pairs if producer == "arrow" else pairs.where(~lsb), password, producer=producer).withColumn(
        "hash_ok", F.col("found_hash") == F.substring("cover_sha256", 1, HEAD_BITS // 4))
    cols = [*PHOTO, "to_variant", "method", "p", "density", "msg_bytes",
            (F.col("found_text") == F.col("message")).alias("text_ok"), "hash_ok"]
    if producer == "arrow":
        return blocks.select(*cols)
    plain = extract_lsb_text(pairs.where(lsb)).withColumn("hash_ok", F.lit(None).cast("boolean"))
    return blocks.select(*cols).unionByName(plain.select(*cols))


def replay_records(records: DataFrame, covers: DataFrame, password: str = "") -> DataFrame:
    """Code every record's message into its cover again and read it back: rows (record_id, cover_sha256, message_sha256,
    changed_cells, stego_sha256) of what comes out.

    ``records`` has (record_id, source, photo_id, method, p, message). The message's hash is that of the text that was
    extracted from the new image. A record without a cover, or whose message does not fit, has no row.
    """
    pairs = records.select("record_id", *PHOTO, F.col("method").alias("_method"), F.col("p").alias("_p"), "message").join(
        covers.select(*PHOTO, "height", "width", "px"), PHOTO)
    task = F.expr(f"array({coding_job('cast(record_id as string)', '_method', '_p', '0D', '_text')})").cast(T.ArrayType(coding.JOB))
    todo = pairs.withColumnRenamed("message", "_text").withColumn("jobs", F.filter(task, lambda j: j["status"] == "ok"))
    back = extract_text(coding.code_covers(todo.drop("_method", "_p", "_text"), password), password)
    return back.select("record_id", "cover_sha256", F.sha2(F.encode("found_text", "UTF-8"), 256).alias("message_sha256"),
                       changed_pixels().alias("changed_cells"), content_hash("coded").alias("stego_sha256"))


# ---------------------------------------------------------------- reports
def code_family(df_range: DataFrame) -> DataFrame:
    """Block code by parameter p: length, information cells, rate, ideal bits per change."""
    return df_range.select(
        "p", F.expr("shiftleft(1, p) - 1").alias("n"), F.expr("shiftleft(1, p) - 1 - p").alias("k")).select(
        "p", "n", "k", (F.col("k") / F.col("n")).alias("code_rate"),
        (F.col("p") * (F.col("n") + 1) / F.col("n")).alias("alpha"))


def measured_efficiency(pairs: DataFrame) -> DataFrame:
    """Message bits per changed pixel by code parameter, beside the ideal value."""
    per_p = (pairs.withColumn("changed", changed_pixels()).groupBy("method", "p").agg(
        F.sum(F.col("msg_bytes").cast("long") * 8 + LENGTH_BITS).alias("bits"),
        F.sum("changed").alias("changed")))
    family = code_family(pairs.sparkSession.range(1, 9).select(F.col("id").cast("int").alias("p")))
    return per_p.join(F.broadcast(family), "p").select(
        "method", "p", "n", "alpha", "bits", "changed",
        F.when(F.col("changed") > 0, F.col("bits") / F.col("changed")).otherwise(0.0).alias("measured_alpha"))


def quality(pairs: DataFrame) -> DataFrame:
    """Changed share and mean squared error of coded pixels against their cover."""
    square = F.aggregate(F.zip_with("px", "coded", lambda a, b: ((a - b) * (a - b)).cast("long")),
                         F.lit(0).cast("long"), lambda acc, x: acc + x)
    return pairs.withColumn("changed", changed_pixels()).withColumn("square_error", square)
