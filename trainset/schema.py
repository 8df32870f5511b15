"""Canonical record layout and the fixed vocabulary around it."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
KINDS = ("trace", "text", "completion", "image")
ROLES = ("system", "user", "assistant", "tool")
TRAIN_ON = ("assistant", "last", "all")
MEDIA_TYPES = ("image", "audio", "video", "file")
REASONING_KEYS = ("reasoning", "reasoning_content", "thinking", "thought")
ROLE_ALIASES = {
    "human": "user",
    "user": "user",
    "prompter": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "chatgpt": "assistant",
    "system": "system",
    "developer": "system",
    "tool": "tool",
    "function": "tool",
    "observation": "tool",
    "ipython": "tool",
    "function_response": "tool",
    "tool_response": "tool",
}
ERRORS = (
    "not_an_object", "ambiguous", "unknown_record", "empty_text", "bad_completion",
    "empty_completion", "bad_image", "bad_caption", "no_messages", "bad_message", "bad_role",
    "bad_content", "bad_arguments", "bad_tool_calls", "empty_assistant", "empty_message",
    "orphan_tool_result", "bad_chosen", "bad_rejected", "bad_train_on", "nothing_to_learn",
    "bad_tools", "bad_documents", "invalid_json",
)
WARNINGS = (
    "bad_content_part", "unparsed_arguments", "empty_tool_result", "system_not_first",
    "starts_without_user", "unanswered_tool_calls", "extra_tool_result", "repeated_role",
    "trailing_messages", "bad_document", "empty_caption",
)
MAX_REPEAT = 100
IGNORE_INDEX = -100
# -----------------------------------------------------------------------------

PART = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "text", "ref", "mime", "format", "name")]
)
TOOLCALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("args_is_object", T.BooleanType()),
        T.StructField("type", T.StringType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("content_is_json", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOLCALL)),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("train", T.BooleanType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
TOOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("returns", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("strict", T.BooleanType()),
        T.StructField("examples", T.StringType()),
    ]
)
DOC = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "source", "id")])
ISSUE = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("index", T.IntegerType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("tools", T.ArrayType(TOOL)),
        T.StructField("tool_choice", T.StringType()),
        T.StructField("documents", T.ArrayType(DOC)),
        T.StructField("template_kwargs", T.StringType()),
        T.StructField("train_on", T.StringType()),
        T.StructField("chosen", T.ArrayType(MESSAGE)),
        T.StructField("rejected", T.ArrayType(MESSAGE)),
        T.StructField("label", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("captions", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("repeat", T.IntegerType()),
        T.StructField("meta", T.StringType()),
        T.StructField("meta_source", T.StringType()),
        T.StructField("meta_license", T.StringType()),
        T.StructField("meta_lang", T.StringType()),
        T.StructField("meta_synthetic", T.BooleanType()),
    ]
)


def ddl(t: T.DataType) -> str:
    return t.simpleString()
