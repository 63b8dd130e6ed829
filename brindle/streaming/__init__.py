"""The engine's queries read finite tables only; there is no streaming operator to offer."""
