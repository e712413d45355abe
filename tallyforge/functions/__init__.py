"""Part of tallyforge; see the README."""
