"""Training-data operators. Nothing outside this subpackage imports it (the driver entry asks whether it exists)."""
