"""Deterministic stand-ins for model endpoints, used by the registered queries and the tests."""

from __future__ import annotations

import hashlib


def completion_endpoint():
    """Answers with a digest of the prompt; some prompts fail and some get no content."""

    def call(messages, params):
        prompt = messages[-1]["content"]
        if "onth" in prompt:
            raise TimeoutError("endpoint timed out")
        if "quer" in prompt:
            return None
        return f"{params.model} {len(messages)} {hashlib.md5(prompt.encode()).hexdigest()}"

    return call


def echo_endpoint():
    """Answers with the question at the end of the prompt, slightly misspelled."""

    def call(messages, params):
        prompt = messages[-1]["content"]
        if "onth" in prompt:
            raise TimeoutError("endpoint timed out")
        return prompt.split("Q: ")[-1].replace("e", "a")

    return call


def judge_endpoint():
    """Judges by the number of times the letter e occurs in the prompt."""

    def call(messages, params):
        prompt = messages[-1]["content"]
        count = prompt.count("e")
        if count % 7 == 0:
            raise ConnectionError("endpoint is gone")
        if count % 7 == 1:
            return None
        if count % 7 == 2:
            return "[Corr"
        return " [Correct]\n" if count % 2 == 0 else "[Incorrect] "

    return call
