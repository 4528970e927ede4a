"""Writers for results and exports."""
