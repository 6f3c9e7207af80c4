"""Part of the stockweave package."""
