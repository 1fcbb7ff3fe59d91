"""Words that op6 asks the model for, against the library's whole encoding."""

import public_tokenizers
import pyarrow as pa

from millrace.llm.wavelet import WordCodec


def test_plain_words_go_to_the_model_alone(monkeypatch):
    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", " ", ".", "Word. word, WORD.. İx ßtraße, 日本語 éa it's b", "<|endoftext|> x<|startoftext|>y 12.5, x.y.", "qzxv anbleatou thing"]
    ids, first = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [codec.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(codec, "_letters", lambda items: [codec._raw([w])[0] for w in items if 1 / (not w.isascii())])
    assert len(codec.encode(pa.array(["plainest letters", "ÉTÉ"]))[1]) == 3  # letters went through all of the tokenizer's steps before


def test_letters_meet_the_model_once_in_lower_case_without_punctuation(monkeypatch):
    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    marks = [c for c in map(chr, range(1, 0x250)) if not c.isspace()]
    texts = [f"Ab{c}cd {c}{c}## {c}" for c in marks] + [f"ab{c}{d}x'S {c}{d}" for c in "éß'.&|<>9" for d in marks]
    texts += ["e\u0301x### J\u030cq Σας ΟΔΟΣ, ǅz ŉa ſt", "it's## '## ab'## ab'S ab'', <|endoftext|>## x<|endoftext|>", "a\u00a0b\u3000c\u0085d \ufeffx"]
    ids, first = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    raw, model, fresh = [], [], WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(fresh, "_raw", lambda items, f=fresh._raw: raw.extend(items) or f(items))
    monkeypatch.setattr(fresh, "_asked", lambda items, f=fresh._asked: model.extend(items) or f(items), raising=False)
    fresh.encode(pa.array(["Plain### plain&&& PLAIN.", "Été$$$ été", "x1"]))
    assert sorted(model) == ["plain", "été"] and sorted(raw) == ["###", "$$$", "&&&", ".", "x1"]
