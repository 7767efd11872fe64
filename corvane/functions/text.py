"""Text functions over Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that are decoded; the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    """Named and numeric entities as characters."""
    parts = F.regexp_extract_all(text, F.lit(r"&#[0-9]{1,7};|[^&]+|&"), F.lit(0))
    # Code points beyond what char() covers are built from their UTF-8 bytes.
    numeric = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^&#[0-9]{1,7};$"), _point(F.regexp_extract(p, r"[0-9]+", 0).cast("int"))).otherwise(p)), "")
    out = F.when(text.contains("&#"), numeric).otherwise(text)
    return reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, out)


def _point(n: Column) -> Column:
    def byte(x: Column) -> Column:
        return F.lpad(F.hex(x), 2, "0")

    low = lambda shift: F.lit(128) + F.shiftright(n, shift).bitwiseAND(F.lit(63))
    code = (
        F.when(n < 128, byte(n))
        .when(n < 2048, F.concat(byte(F.lit(192) + F.shiftright(n, 6)), byte(low(0))))
        .when(n < 65536, F.concat(byte(F.lit(224) + F.shiftright(n, 12)), byte(low(6)), byte(low(0))))
        .otherwise(F.concat(byte(F.lit(240) + F.shiftright(n, 18)), byte(low(12)), byte(low(6)), byte(low(0))))
    )
    return F.decode(F.unhex(code), "UTF-8")


def has_entities(text: Column) -> Column:
    return text.rlike(r"&(?:lt|gt|quot|apos|nbsp|amp|#[0-9]{1,7});")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.(\w+)$", 1)


def fixed_extension(ext: Column, path: Column) -> Column:
    """The stored extension, or that of the path in lower case where it begins with a dot, differs from it or isn't in lower case."""
    own = F.lower(extension(path))
    return F.when(ext.startswith(".") | (F.lower(ext) != own) | (ext != F.lower(ext)), own).otherwise(ext)


def extension_faults(files):
    """(n_dotted, n_differing) of files (ext, path): extensions that begin with a dot, and those not in lower case or other than the path's."""
    ext, own = F.col("ext"), F.lower(extension(F.col("path")))
    return files.agg(F.count_if(ext.startswith(".")).alias("n_dotted"), F.count_if((F.lower(ext) != own) | (ext != F.lower(ext))).alias("n_differing"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def split_list(text: Column, mark: str = ";;") -> Column:
    return F.transform(F.split(text, mark), lambda x: F.trim(x))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def tag_pattern(label: Column, aliases: Column) -> Column:
    """(^label$)|(^alias$)...: blanks, dashes and underscores stand for any run of those and dots."""
    one = lambda t: F.concat(F.lit("(^"), F.regexp_replace(escaped(t), r"[\s\-_]+", r"[\\s\\-_\\.]+"), F.lit("$)"))
    return F.array_join(F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), one), "|")


def relevance(query: str, label: Column, aliases: Column) -> Column:
    """Some name equals, begins with, holds, or only shares words with the query. The tiers 100, 50, 25 and 10."""
    q = query.lower()
    names = F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), F.lower)
    return F.when(F.exists(names, lambda n: n == q), 100).when(F.exists(names, lambda n: n.startswith(q)), 50).when(F.exists(names, lambda n: n.contains(q)), 25).otherwise(10)


def matches_all_terms(query: str, label: Column, aliases: Column) -> Column:
    """Each term between single blanks occurs in some name; the empty term occurs everywhere."""
    names = F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), F.lower)
    return reduce(Column.__and__, (_some(names, term) for term in query.lower().split(" ")))


def _some(names: Column, term: str) -> Column:
    return F.exists(names, lambda n: n.contains(term))


def seconds(clock: Column) -> Column:
    """h:mm:ss, m:ss or s to seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda s, p: s * 60 + p.cast("double"))


def fraction(text: Column) -> Column:
    """30000/1001 as a number."""
    parts = F.split(text, "/")
    return F.get(parts, F.lit(0)).cast("double") / F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(1.0))


def field_value(blob: Column, name: str, end: str = ",", start: str = ": ") -> Column:
    """What follows the first name, up to the next mark or the end, without one blank at either side of a line; null where the name isn't there."""
    mark = name + start
    rest = F.when(blob.contains(f"{name}: ") & blob.contains(mark), _after(blob, mark))
    return F.regexp_replace(F.substring_index(rest, end, 1), r"(?m)^\s|\s$", "")


def _after(text: Column, mark: str) -> Column:
    """The text after the first occurrence of a mark."""
    return F.substr(text, F.instr(text, mark) + len(mark))


def _number(value: Column) -> Column:
    """An empty field is 0, what is no number missing."""
    return F.when(F.trim(value) == "", 0.0).otherwise(F.trim(value).try_cast("double"))


#: The field names of parameter blobs, by the names of our columns.
NUMBERS = {
    "cfg_scale": "CFG scale", "clip_skip": "Clip skip", "hires_denoising_strength": "Hires denoising strength", "hires_scale": "Hires scale", "hires_steps": "Hires steps",
    "seed": "Seed", "steps": "Steps", "subseed": "Variation seed", "subseed_strength": "Variation seed strength",
}
TEXTS = {"model": "Model", "model_hash": "Model hash", "hires_upscaler": "Hires upscaler", "face_restoration": "Face restoration", "sampler": "Sampler"}
EXTENSION_NUMBERS = {
    "confidence": "ADetailer confidence", "denoising_strength": "ADetailer denoising strength", "dilate_erode": "ADetailer dilate/erode", "inpaint_padding": "ADetailer inpaint padding",
    "mask_blur": "ADetailer mask blur", "mask_only_top_k_largest": "ADetailer mask_only_top_k_largest",
}
PROMPT_END, SETTINGS = "Negative prompt: ", "Steps: "


def parameters(blob: Column) -> Column:
    """A struct of a generation parameter blob; missing fields are null, and so is a size that can't be read.

    The prompt ends at the negative prompt or, without one, at the settings; fields are looked for in the settings only.
    """
    has_settings = blob.contains(SETTINGS)
    rest = F.when(has_settings, F.substr(blob, F.instr(blob, SETTINGS))).otherwise(blob)
    head = F.when(has_settings, F.substring_index(blob, SETTINGS, 1)).otherwise(F.when(blob.contains(PROMPT_END), blob).otherwise(F.when(blob.isNotNull(), "")))
    number = lambda name: _number(field_value(rest, name))
    size = F.split(field_value(rest, "Size"), "x")
    detail = F.struct(
        *(number(name).alias(c) for c, name in EXTENSION_NUMBERS.items()), F.lit(True).alias("enabled"), field_value(rest, "ADetailer model").alias("model"),
        (F.coalesce(field_value(rest, "ADetailer inpaint only masked"), F.lit("")) != "False").alias("inpaint_only_masked"),
    )
    return F.struct(
        F.regexp_replace(F.substring_index(head, PROMPT_END, 1), r"(?m)[\n\r]$", "").alias("prompt"),
        F.when(head.contains(PROMPT_END), F.regexp_replace(_after(head, PROMPT_END), r"[\n\r]|(?i:Negative prompt:\s)", "")).alias("negative_prompt"),
        *(number(name).alias(c) for c, name in NUMBERS.items()),
        *(field_value(rest, name).alias(c) for c, name in TEXTS.items()),
        F.get(size, F.lit(0)).try_cast("int").alias("width"), F.get(size, F.lit(1)).try_cast("int").alias("height"),
        F.coalesce(rest.contains("Hires upscaler: "), F.lit(False)).alias("is_upscaled"),
        F.coalesce(field_value(rest, '"vae"', '"', ': "'), F.lit("None")).alias("vae_hash"),
        field_value(rest, "Template", "Negative Template").alias("template"), field_value(rest, "Negative Template", "\r").alias("negative_template"),
        detail.alias("adetailer"),
    )


def model_tags(parsed: Column, original_tag: str, upscaled_tag: str, parent_label: str) -> Column:
    """The tag a parsed blob asks for by its model, and that by its kind: (label, alias, parent_label, kind_tag)."""
    return F.struct(
        F.concat(F.lit("Diff Model: "), parsed["model"]).alias("label"), F.concat(F.lit("Model Hash: "), parsed["model_hash"]).alias("alias"),
        F.lit(parent_label).alias("parent_label"), F.when(parsed["is_upscaled"], upscaled_tag).otherwise(original_tag).alias("kind_tag"),
    )


def replaced_once(text: Column, find: str, new: str) -> Column:
    """text with the first occurrence of find replaced, taken literally."""
    at = F.instr(text, find)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(find)))).otherwise(text)


def fixed_picture_path(path: Column) -> Column:
    """A picture's path that ends in a stray backslash before its extension, without it."""
    return F.when(path.endswith("\\.jpg"), replaced_once(path, "\\.jpg", ".jpg")).otherwise(path)


def float_array(text: Column) -> Column:
    """A JSON list of numbers; null where it is none."""
    return F.from_json(text, "array<double>")


#: What a library takes as pictures, films and films a browser plays, unless it is told otherwise.
IMAGES = ("bmp", "gif", "jpeg", "jpg", "png", "tiff", "webp")
VIDEOS = ("avi", "m4v", "mkv", "mov", "mp4", "ts", "webm", "wmv")
WEB_VIDEOS, WEB_CODECS = ("mp4", "webm"), ("h264", "vp8", "vp9")


def extension_class(ext: Column, images: tuple = IMAGES, videos: tuple = VIDEOS, remuxable: tuple = ("ts",)) -> Column:
    """(is_image, is_video, is_animated, is_remuxable) of an extension in any case."""
    e = F.lower(ext)
    return F.struct(e.isin(*images).alias("is_image"), e.isin(*videos).alias("is_video"), e.isin("gif", *videos).alias("is_animated"), e.isin(*remuxable).alias("is_remuxable"))


def web_playable(ext: Column, codec: Column, videos: tuple = WEB_VIDEOS, codecs: tuple = WEB_CODECS) -> Column:
    return F.coalesce(F.lower(codec).isin(*codecs) & F.lower(ext).isin(*videos), F.lit(False))


def earliest(*times: Column) -> Column:
    """The least of several times; missing ones don't count."""
    return F.least(*times)


def latest(*times: Column) -> Column:
    return F.greatest(*times)


def iso(time: Column) -> Column:
    """A time in UTC as text that sorts as the time does."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
