"""Writers of export rows."""
