"""Reading the scholarly inputs and earlier builds; writing builds and exports."""
