"""Path, naming, option and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's speaker id domain (15 speakers).
SPEAKERS = ["F01", "F03", "F04", "FC01", "FC02", "FC03", "M01", "M02", "M03", "M04", "M05",
            "MC01", "MC02", "MC03", "MC04"]
# The reference's speaker-from-file-name pattern and fold prefix.
SPEAKER_PATTERN = r"^([A-Z]C?\d{2})_"
FOLD_PREFIX = "held-out-"


def basename(path: Column) -> Column:
    """T4: last path part."""
    return F.substring_index(path, "/", -1)


def relative_to(path: Column, root: str) -> Column:
    """T4: path relative to ``root`` (prefix removed)."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30)).otherwise(path)


def speaker_from_name(path: Column) -> Column:
    """Id from the file name by pattern, else the text before the first '_'."""
    b = basename(path)
    return F.coalesce(F.nullif(F.regexp_extract(b, SPEAKER_PATTERN, 1), F.lit("")),
                      F.substring_index(b, "_", 1))


def known_speaker(speaker: Column) -> Column:
    """Membership in the speaker domain (strict callers raise on False)."""
    return speaker.isin(SPEAKERS)


def strict_speaker(speaker: Column, path: Column) -> Column:
    """P7 strict mode: unknown ids raise with the value and the file name."""
    return F.when(known_speaker(speaker), speaker).otherwise(F.raise_error(F.concat(
        F.lit("Unknown speaker derived from path: "), speaker, F.lit(" ("), basename(path), F.lit(")"))))


def fold_speaker(dir_name: Column) -> Column:
    """T5: speaker from a 'held-out-<speaker>' directory name ('' if absent)."""
    return F.regexp_extract(basename(dir_name), "^" + FOLD_PREFIX + "(.+)$", 1)


def output_slug(source: Column, selection: Column | None = None, fallback: str = "model") -> Column:
    """Last path part, chars outside letters/digits/'_'/'-' -> '-', '-' stripped,
    fallback name, then '-' + selection when given."""
    last = basename(F.regexp_replace(source, "/+$", ""))
    s = F.regexp_replace(last, r"[^\p{L}\p{N}_-]", "-")
    s = F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit(fallback))
    return s if selection is None else F.when(selection.isNull() | (selection == ""), s) \
        .otherwise(F.concat(s, F.lit("-"), selection))


def layer_slug(spec: Column) -> Column:
    """Trim, lower, ',' -> '_'."""
    return F.regexp_replace(F.lower(F.trim(spec)), ",", "_")


def module_list(spec: Column) -> Column:
    """The names of a comma-separated list, stripped, repeats dropped; an empty name or list raises."""
    names = F.transform(F.split(spec, ","), lambda s: F.trim(s))
    bad = F.raise_error(F.concat(F.lit("invalid module list: "), F.coalesce(spec, F.lit("null")))).cast("array<string>")
    return F.when(spec.isNotNull() & ~F.array_contains(names, ""), F.array_distinct(names)).otherwise(bad)


def method_name(scope: Column, options: Column) -> Column:
    """The folder name of a fine-tuning method, by scope, from its ``options`` (a map of texts): full,
    lora, adapter, components and, for any other scope, partial."""
    o = lambda k: options[k]
    layers = lambda e, d: F.concat(F.lit("-enc"), layer_slug(o(e)), F.lit("-dec"), layer_slug(o(d)))
    joined = lambda k: F.array_join(module_list(o(k)), "_")
    return (F.when(scope == "full", F.lit("full-finetune"))
            .when(scope == "lora", F.concat(F.lit("lora-r"), o("lora_rank"), F.lit("-a"), o("lora_alpha"), F.lit("-"), joined("lora_target_modules")))
            .when(scope == "adapter", F.concat(F.lit("adapter-dim"), o("adapter_dim"), layers("adapter_encoder_layers", "adapter_decoder_layers")))
            .when(scope == "components", F.concat(F.lit("component-finetune-"), joined("train_components"),
                                                  layers("train_encoder_layers", "train_decoder_layers")))
            .otherwise(F.concat(F.lit("partial-finetune"), layers("train_encoder_layers", "train_decoder_layers"))))


def checkpoint_folder(path: Column) -> Column:
    """Whether a model path's last part names a training checkpoint."""
    return basename(F.regexp_replace(path, "/+$", "")).contains("checkpoint-")


def distilled(model: Column) -> Column:
    """Whether a model's name says that it is distilled."""
    return model.contains("distil")


def english_only(model: Column) -> Column:
    """T8: '.en' inside or '-en' at the end of the model name."""
    m = F.lower(model)
    return m.contains(".en") | m.endswith("-en")


def generation_options(max_tokens: int, language: Column, task: Column, en_only: Column) -> Column:
    """Option map -- token cap; language unless auto/empty; task if set;
    neither language nor task for English-only models."""
    lang_ok = (~en_only) & language.isNotNull() & (F.lower(language) != "auto") & (language != "")
    task_ok = (~en_only) & task.isNotNull() & (task != "")
    m = F.map_from_arrays(F.array(F.lit("max_new_tokens"), F.lit("language"), F.lit("task")),
                          F.array(F.lit(str(max_tokens)), F.when(lang_ok, language), F.when(task_ok, task)))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def iso_utc(ts: Column) -> Column:
    """ISO-8601 UTC text as Python's ``isoformat()`` (fraction only if non-zero)."""
    # from the instant itself, so the session's time zone does not matter
    micros = F.unix_micros(ts)
    seconds, day_s = F.floor(micros / 1_000_000).cast("bigint"), 86_400
    frac = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    of_day = F.pmod(seconds, F.lit(day_s))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / day_s).cast("int")).cast("string")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")
    base = F.concat(date, F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day / 60) % 60), F.lit(":"), two(of_day % 60))
    return F.concat(base, F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
                    F.lit("+00:00"))


def json_object(text: Column) -> Column:
    """The text parsed as a JSON object; anything else raises."""
    return F.when(F.json_object_keys(text).isNotNull(), text).otherwise(
        F.raise_error(F.lit("JSON root is not an object")))


def base_model(override: Column, adapter_config: Column) -> Column:
    """Explicit override, else the adapter config's base model (empty text counts as none), else error."""
    return F.coalesce(F.nullif(override, F.lit("")),
                      F.nullif(F.get_json_object(adapter_config, "$.base_model_name_or_path"), F.lit("")),
                      F.raise_error(F.lit("base model is not declared")).cast("string"))


def expand_targets(target: Column, corpora: tuple[str, str] = ("primary", "retention")) -> Column:
    """P14: 'both' -> the two evaluation corpora, else the target itself."""
    return F.when(target == "both", F.array(*[F.lit(c) for c in corpora])).otherwise(F.array(target))
