"""Writers, merges, versioning and table maintenance."""
