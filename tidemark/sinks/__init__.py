"""Writers and text renderings."""
