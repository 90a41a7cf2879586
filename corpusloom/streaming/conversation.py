"""A two-person conversation as a state machine over ordered events.

The mic never opens while speech plays; a tap cuts the running turn; events whose ids no longer match are ignored. `Machine`
holds one conversation's state and turns an event into effects; `effects` runs it per conversation over a table (events in
order of seq), `stream_effects` over a stream."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

BUSY = "busy"
NO_SPEECH = "no speech"


@dataclass
class Machine:
    phase: str = "idle"  # idle, listening, processing, speaking
    party: str | None = None
    turn: int | None = None
    speak_id: int | None = None
    background: dict[int, str] = field(default_factory=dict)
    typed: list[int] = field(default_factory=list)
    next_turn: int = 1
    next_speak: int = 1

    def to(self, phase: str, party=None, turn=None, speak_id=None):
        self.phase, self.party, self.turn, self.speak_id = phase, party, turn, speak_id

    def handle(self, e: dict) -> list[tuple]:
        return getattr(self, "on_" + e["kind"])(e)

    def _hush(self, keep=None) -> list[tuple]:
        """Stop what is being spoken, if anything is; its turn counts as interrupted unless it is `keep`."""
        if self.phase != "speaking":
            return []
        cut = [] if self.turn is None or self.turn == keep else [("mark_interrupted", self.turn)]
        return [("stop_speak", None), *cut]

    def _listen(self, party: str) -> tuple:
        self.to("listening", party, self.next_turn)
        self.next_turn += 1
        return "start_listen", self.turn

    def on_tap(self, e):
        out = self._hush()
        if self.phase == "listening":
            out.append(("stop_listen", self.turn))
            if self.party == e["party"]:
                self.to("processing", self.party, self.turn)
                return out
        if self.phase in ("listening", "processing"):
            self.background[self.turn] = self.party
        return [*out, self._listen(e["party"])]

    def _take(self, party, turn, text, first, keep=None):
        """Translate keyboard text: in front if nothing runs, else in the background."""
        self.typed.append(turn)
        out = [first, ("translate", turn)]
        if self.phase in ("idle", "speaking"):
            out = [*self._hush(keep), *out]
            self.to("processing", party, turn)
        else:
            self.background[turn] = party
        return out

    def on_typed(self, e):
        if not (text := (e.get("text") or "").strip()):
            return []
        turn, self.next_turn = self.next_turn, self.next_turn + 1
        if e.get("keep"):
            return [("add_message", turn), ("set_translation:ok", turn)]
        return self._take(e["party"], turn, text, ("add_message", turn))

    def on_edited(self, e):
        turn = e["turn"]
        if not (text := (e.get("text") or "").strip()) or turn >= self.next_turn:
            return []
        if turn in self.background or self.phase in ("listening", "processing"):
            return [("notice:" + BUSY, None)]
        if e.get("keep"):
            out = [*self._hush(turn), ("replace_source", turn), ("set_translation:ok", turn)]
            self.to("idle")
            return out
        return self._take(e["party"], turn, text, ("replace_source", turn), keep=turn)

    def on_listen_ended(self, e):
        turn, heard = e["turn"], e["result"] == "text"
        if turn in self.background:
            if heard:
                return [("add_message", turn), ("translate", turn)]
            del self.background[turn]
            return []
        if self.phase not in ("listening", "processing") or self.turn != turn:
            return []
        if heard:
            self.to("processing", self.party, turn)
            return [("add_message", turn), ("translate", turn)]
        self.to("idle")
        return [("notice:" + (NO_SPEECH if e["result"] == "no_speech" else e.get("text") or ""), None)]

    def on_translated(self, e):
        turn, result = e["turn"], e["result"]  # ok, no_translator, failed, invalid
        notice = [("notice:" + (e.get("text") or ""), None)]
        if turn in self.background:
            del self.background[turn]
            keyboard = self._forget(turn)
            shown = ("ok" if keyboard else "not_played") if result == "ok" else result
            return [(f"set_translation:{shown}", turn), *(notice if result == "invalid" else [])]
        if self.phase != "processing" or self.turn != turn:
            return []
        if result == "ok" and turn not in self.typed:
            speak, self.next_speak = self.next_speak, self.next_speak + 1
            self.to("speaking", self.party, turn, speak)
            return [("set_translation:ok", turn), ("speak", speak)]
        self._forget(turn)
        self.to("idle")
        return [(f"set_translation:{result}", turn), *(notice if result in ("failed", "invalid") else [])]

    def _forget(self, turn) -> bool:
        was = turn in self.typed
        self.typed = [t for t in self.typed if t != turn]
        return was

    def on_speak_done(self, e):
        if self.phase == "speaking" and self.speak_id == e.get("speak_id"):
            self.to("idle")
        return []

    def on_stop_speaking(self, e):
        out = self._hush()
        if out:
            self.to("idle")
        return out

    def on_replay(self, e):
        if self.phase not in ("idle", "speaking"):
            return []
        out, speak, self.next_speak = self._hush(), self.next_speak, self.next_speak + 1
        self.to("speaking", None, None, speak)
        return [*out, ("speak", speak)]

    def on_reset(self, e):
        out = {"listening": [("stop_listen", self.turn)], "speaking": [("stop_speak", None)]}.get(self.phase, [])
        self.__init__(next_turn=max(self.next_turn, e.get("turn") or 0), next_speak=self.next_speak)
        return out


COLUMNS = "conv_id long, seq long, effect string, id long"


def _run(machine: Machine, conv_id, events: pd.DataFrame) -> pd.DataFrame:
    out = []
    for e in events.sort_values("seq").to_dict("records"):
        e = {k: None if isinstance(v, float) and v != v else int(v) if k in ("turn", "speak_id") and v is not None else v for k, v in e.items()}
        out += [(conv_id, e["seq"], name, n) for name, n in machine.handle(e)]
    return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate((("conv_id", "int64"), ("seq", "int64"), ("effect", "object"), ("id", "Int64")))})


def effects(events: DataFrame) -> DataFrame:
    """conv_id, seq, effect, id of every effect. Events: conv_id, seq, kind, party, turn, speak_id, text, keep, result."""
    return events.groupBy("conv_id").applyInPandas(lambda key, pdf: _run(Machine(), key[0], pdf), COLUMNS)


def stream_effects(events: DataFrame) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        machine = Machine()
        if state.exists:
            kept = json.loads(state.get[0])
            machine = Machine(**(kept | {"background": {int(k): v for k, v in kept["background"].items()}}))
        for pdf in batches:
            yield _run(machine, key[0], pdf)
        state.update((json.dumps(asdict(machine)),))

    return events.groupBy("conv_id").applyInPandasWithState(step, COLUMNS, "machine string", "append", GroupStateTimeout.NoTimeout)
